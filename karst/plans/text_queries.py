"""Queries of text functions, citations, plans and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from karst.functions import citations, text
from karst.operators import answers, planning
from karst.plans.standin import SETTINGS, table
from karst.sources.documents import strict_json

#: Rows of Arabic text beside the driver's tables, which have none.
ARABIC = [
    (-1, "إجازة ٦٠ يوماً"), (-2, "أجر، مدة"), (-3, "café"), (-4, "العامل في إجازة مرضية"), (-5, "الأجرُ والمكافآتُ ۱۲"), (-6, "ـــتطويل  ونص"), (-7, "آخر إنذار مؤكد رئيس هدى"), (-8, ""),
]


def _texts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs.union(spark.createDataFrame(ARABIC, "id long, text string"))


def text_preview(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    none = F.array().cast("array<string>")
    ar = F.when(F.col("quality") == 1, F.array("text")).otherwise(none)
    en = F.when(F.col("quality") == 0, F.array("source", "text")).otherwise(none)
    searchable = F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("Local name: "), F.col("lang")))
    return rows.select("doc_id", text.first_text(ar, en, searchable, 300).alias("preview"), text.seed_label(ar, en, F.col("lang")).alias("label"))


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("id", text.normalize_arabic(F.col("text")).alias("normalized"))


def content_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d).withColumn("n", text.normalize_arabic(F.col("text")))
    rows = rows.select("id", text.content_tokens(F.col("n")).alias("found"))
    return rows.select("id", F.array_join(F.sort_array("found"), " ").alias("tokens"), F.get("found", F.lit(0)).alias("first"))


def lexical_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Every document against the benchmark item of its number."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    n = items.agg(F.count(F.lit(1)).alias("n"))
    pairs = docs.select("doc_id", "text").crossJoin(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n"))
    pairs = pairs.join(items.select("item_id", F.col("text").alias("question")), "item_id")
    pairs = pairs.withColumns({"q": text.normalize_arabic(F.col("question")), "a": text.normalize_arabic(F.col("text"))})
    return pairs.select("doc_id", F.round(text.relevance(F.col("q"), F.col("a")), 6).alias("relevance"))


def local_names(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select("page_id", "url").where("url IS NOT NULL")
    uri = F.concat(F.lit("http://example.org/law#article_"), F.col("page_id").cast("string"))
    return pages.select("page_id", text.local_name(F.col("url")).alias("local_name"), text.article_number(uri).alias("article_number"), text.article_number(F.col("url")).alias("no_number"))


def slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" / ", "p_name", "p_brand", F.lit("_"))).alias("slug"))


def arabic_only(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("id", text.arabic_only(F.col("text")).alias("arabic_only"))


def char_budget(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", text.char_budget((F.col("o_orderkey") % 30).cast("int")).alias("budget"))


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    issue = text.embedding_text(F.col("source"), F.col("lang"), F.array("lang", "source", F.lit(" hint ")))
    return table(spark, d, "documents").select("doc_id", F.coalesce(text.excerpt(F.col("text"), 120), F.lit("")).alias("excerpt"), issue.alias("embedding_text"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """An answer per order, citing its parts in forms that change with the line number; allowed are the parts' even numbers."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 40 + 1).cast("int").alias("n"))
    n = F.col("n").cast("string")
    form = (
        F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("[[المادة "), n, F.lit("]")))
        .when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit("[المادة "), n, F.lit("]")))
        .when(F.col("l_linenumber") % 4 == 2, F.concat(F.lit("[مادة "), F.translate(n, "0123456789", "٠١٢٣٤٥٦٧٨٩"), F.lit("]")))
        .otherwise(F.concat(F.lit("نص "), n, F.lit(" .")))
    )
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "n", form.alias("t")))).alias("x"))
    numbers = F.transform("x", lambda e: e["n"])
    return rows.select(
        "l_orderkey",
        F.concat(F.lit("قول "), F.array_join(F.transform("x", lambda e: e["t"]), " ثم ")).alias("answer"),
        F.when(F.col("l_orderkey") % 3 == 0, F.array_distinct(numbers)).otherwise(F.array().cast("array<int>")).alias("cited"),
        F.array_distinct(F.filter(numbers, lambda k: (k % 2 == 0) | (F.col("l_orderkey") % 2 == 0))).alias("allowed"),
    )


def _joined(c):
    return F.array_join(F.transform(c, lambda n: n.cast("string")), ",")


def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    rows = _answers(spark, d)
    return rows.select("l_orderkey", _joined(citations.inline_numbers(F.col("answer"))).alias("inline"), _joined(citations.evaluated_numbers(F.col("answer"))).alias("evaluated"), _joined(citations.mentioned_numbers(F.col("answer"))).alias("mentioned"))


def citation_repair(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).select("l_orderkey", citations.repair_brackets(F.col("answer")).alias("repaired"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return answers.judge_drafts(_answers(spark, d))


def citation_state(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("state")
    return _judged(spark, d).select("l_orderkey", *[_joined(s[k]).alias(k) for k in ("inline", "valid_inline", "final", "invalid_inline", "invalid_structured")], s["needs_retry"].alias("needs_retry"))


def answer_routing(spark: SparkSession, d: str) -> DataFrame:
    rows = _judged(spark, d).withColumn("behavior", F.when(F.col("l_orderkey") % 7 == 0, F.lit("abstain")).otherwise(F.lit("retrieve")))
    rows = rows.withColumns({"route": answers.route(F.col("behavior"), F.size("allowed")), "retried": F.col("state")["needs_retry"], "limitations": F.array(F.lit(" "), F.lit(" note "))})
    out = answers.finish(rows)
    return out.select("l_orderkey", "status", "grounded", _joined(F.col("cited_article_numbers")).alias("cited"), F.array_join("warnings", "|").alias("warnings"), F.length("answer").alias("answer_length"))


def plan_validation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", (F.col("event_id") % 97).cast("int"))
    issue = lambda i: F.struct(F.concat(F.lit("issue "), i.cast("string")).alias("issue"), F.when((F.col("k") % 11 == 5) & (i == 2), F.lit("نص المادة ١٢")).otherwise(F.lit("مادة خطرة")).alias("retrieval_query"), F.array(F.col("event_type")).alias("concept_hints"), *[F.array().cast("array<string>").alias(c) for c in ("actors", "conditions", "numbers")], F.lit("").alias("requested_result"))
    n = F.col("k") % 7
    issues = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), issue)).otherwise(F.array().cast(T.ArrayType(planning.ISSUE)))
    decision = F.when(F.col("event_type") == "error", F.lit("abstain")).when(F.col("k") == 13, F.lit("maybe")).otherwise(F.lit("retrieve"))
    plan = F.struct(decision.alias("decision"), (F.col("value") / 50).alias("confidence"), F.lit("").alias("decision_reason"), (F.col("k") % 3).alias("minimum_articles"), (F.col("k") % 5).alias("maximum_articles"), issues.alias("atomic_issues"))
    rows = e.select("event_id", plan.alias("plan"))
    return rows.select("event_id", planning.plan_error(F.col("plan")).alias("error"), planning.needs_verification(F.col("plan")["decision"], F.col("plan")["confidence"], SETTINGS).alias("verify"))


def selection_normalize(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 50).cast("int").alias("n"), (F.col("l_suppkey") % 6).cast("int").alias("issue"), (F.col("l_quantity") > 10).alias("covered"))
    own = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "n", "issue", "covered"))).alias("x"))
    own, n = own.withColumn("n", F.transform("x", lambda e: e["n"])), F.col("n")
    coverage = F.transform("x", lambda e: F.struct(e["issue"].alias("issue_index"), e["covered"].alias("covered"), F.array(e["n"], F.get(n, F.lit(0))).alias("supporting_article_numbers"), F.lit(0.5).alias("confidence"), F.lit("").alias("reason")))
    selection = F.struct(F.slice(n, 1, 2).alias("selected_article_numbers"), coverage.alias("issue_coverage"), F.lit(0.9).alias("confidence"), F.lit("").alias("reason"))
    catalogue = F.when(F.col("l_orderkey") % 5 == 0, F.array().cast("array<int>")).when(F.col("l_orderkey") % 5 == 1, F.slice(n, 1, 3)).otherwise(n)
    rows = own.select("l_orderkey", planning.normalize_selection(selection, catalogue, F.lit(3)).alias("s"))
    covered = F.transform(F.filter(F.coalesce(F.col("s")["coverage"], F.array().cast("array<struct<issue_index:int,covered:boolean,supporting_article_numbers:array<int>,confidence:double>>")), lambda c: c["covered"]), lambda c: c["issue_index"])
    return rows.select("l_orderkey", _joined(F.col("s")["selected"]).alias("selected"), _joined(covered).alias("covered"), F.col("s")["error"].alias("error"))


def rerank_payload(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    o = table(spark, d, "orders")
    c = o.select(F.col("o_custkey").alias("question_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rank"), F.col("o_orderkey").cast("int").alias("article_number"), F.col("o_orderpriority").alias("text"), (F.floor("o_totalprice") / 1000).alias("final_score"))
    return planning.rerank_payload(c, SETTINGS).select("question_id", "n_articles", F.length("payload").alias("payload_length"))


PROPS = T.StructType([T.StructField("k", T.LongType())])


def strict_json_query(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    doc = F.when(F.col("event_id") % 10 == 3, F.regexp_replace("props", r"\}$", ', "x": 1}')).when(F.col("event_id") % 10 == 4, F.lit("{}")).when(F.col("event_id") % 10 == 5, F.lit("[1]")).otherwise(F.col("props"))
    parsed = strict_json(doc, PROPS)
    return e.select("event_id", parsed["value"]["k"].alias("k"), parsed["error"].alias("error"))


strict_json_query.__name__ = "strict_json"

QUERIES = {f.__name__: f for f in (text_preview, normalize_text, content_tokens, lexical_relevance, local_names, slug, arabic_only, char_budget, excerpts, citation_extract, citation_repair, citation_state, answer_routing, plan_validation, selection_normalize, rerank_payload, strict_json_query)}

# --- The same in SQL ------------------------------------------------------------------------------
_ROWS = "SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in ARABIC) + ") AS v(id, text)"
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def _norm(c: str) -> str:
    marks = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"
    plain = f"replace(translate(regexp_replace(nfc_normalize(coalesce({c}, '')), '{marks}', '', 'g'), '{text.FOLD_FROM[:-1]}', '{text.FOLD_TO}'), 'ـ', '')"
    return rf"trim(regexp_replace(lower({plain}), '[^0-9A-Za-z\x{{0600}}-\x{{06FF}}]+', ' ', 'g'))"


_CONTENT = f"list_filter(string_split(n, ' '), lambda w: len(w) > 1 AND NOT list_contains([{_STOP}], w))"
_ARABIC_DIGITS = "translate({}, '٠١٢٣٤٥٦٧٨٩', '0123456789')"
_ANSWERS = """lines AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 40 + 1 AS INTEGER) AS n FROM lineitem),
answers AS (
  SELECT l_orderkey, 'قول ' || string_agg(CASE l_linenumber % 4 WHEN 0 THEN '[[المادة ' || n || ']' WHEN 1 THEN '[المادة ' || n || ']'
      WHEN 2 THEN '[مادة ' || translate(CAST(n AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') || ']' ELSE 'نص ' || n || ' .' END, ' ثم ' ORDER BY l_linenumber, n) AS answer,
    list(n ORDER BY l_linenumber, n) AS ns FROM lines GROUP BY l_orderkey
)"""
_REPAIRED = r"trim(regexp_replace(regexp_replace(list_reduce(list_concat([answer], range(1, 41)::VARCHAR[]), lambda a, k: replace(replace(replace(a, '[[المادة ' || k || ']', '[المادة ' || k || ']'), '[مادة ' || translate(k, '0123456789', '٠١٢٣٤٥٦٧٨٩') || ']', '[المادة ' || k || ']'), '[[المادة ' || k || ']', '[المادة ' || k || ']')), '[ \t]{2,}', ' ', 'g'), '\s+([،؛,.!?])', '\1', 'g'))"


def _ordered(expr: str) -> str:
    """Distinct in the order of first occurrence."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


def _ints(expr: str) -> str:
    return f"list_transform({expr}, lambda x: CAST({_ARABIC_DIGITS.format('x')} AS INTEGER))"


_STATE = rf"""{_ANSWERS},
fixed AS (SELECT l_orderkey, ns, {_REPAIRED} AS answer FROM answers),
found AS (SELECT *, {_ints(r"regexp_extract_all(answer, '\[\s*المادة\s+([0-9٠-٩]+)\s*\]', 1)")} AS cites FROM fixed),
state AS (
  SELECT l_orderkey, answer, {_ordered('cites')} AS inline, CASE WHEN l_orderkey % 3 = 0 THEN {_ordered('ns')} ELSE CAST([] AS INTEGER[]) END AS given,
    list_filter({_ordered('ns')}, lambda k: k % 2 = 0 OR l_orderkey % 2 = 0) AS allowed FROM found
), judged AS (
  SELECT *, list_filter(inline, lambda k: list_contains(allowed, k)) AS valid_inline, list_filter(given, lambda k: list_contains(allowed, k)) AS valid_given,
    list_sort(list_filter(inline, lambda k: NOT list_contains(allowed, k))) AS invalid_inline, list_sort(list_filter(given, lambda k: NOT list_contains(allowed, k))) AS invalid_structured FROM state
), final AS (SELECT *, CASE WHEN len(valid_inline) > 0 THEN valid_inline ELSE valid_given END AS final FROM judged),
told AS (SELECT *, len(invalid_inline) > 0 OR len(invalid_structured) > 0 OR len(final) = 0 AS needs_retry FROM final)"""
_LIST = "array_to_string({}, ',')"

ORACLE_SQL = {
    "text_preview": """SELECT doc_id, substr(coalesce(CASE WHEN quality = 1 THEN text END, CASE WHEN quality = 0 THEN source END, CASE WHEN doc_id % 5 > 0 THEN 'Local name: ' || lang END, ''), 1, 300) AS preview,
        coalesce(CASE WHEN quality = 1 THEN text WHEN quality = 0 THEN source END, lang) AS label FROM documents LEFT JOIN labels USING (doc_id)""",
    "normalize_text": f"SELECT id, {_norm('text')} AS normalized FROM ({_ROWS})",
    "content_tokens": f"SELECT id, array_to_string(list_sort(list_distinct(t)), ' ') AS tokens, t[1] AS first FROM (SELECT id, {_CONTENT} AS t FROM (SELECT id, {_norm('text')} AS n FROM ({_ROWS})))",
    "lexical_relevance": f"""WITH p AS (SELECT d.doc_id, {_norm("b.text")} AS n, {_norm('d.text')} AS a FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
        t AS (SELECT doc_id, n, a, list_distinct({_CONTENT}) AS q, string_split(a, ' ') AS w FROM p), u AS (SELECT *, list_filter(q, lambda x: regexp_full_match(x, '[0-9]+')) AS k FROM t)
        SELECT doc_id, round(CASE WHEN len(q) = 0 THEN 0 ELSE greatest(0, least(1, CAST(0.75 AS DOUBLE) * len(list_intersect(q, w)) / len(q) + CASE WHEN len(k) > 0 THEN CAST(0.20 AS DOUBLE) * len(list_intersect(k, w)) / len(k) ELSE 0 END
          + CASE WHEN n <> '' AND contains(a, n) THEN CAST(0.05 AS DOUBLE) ELSE 0 END)) END, 6) AS relevance FROM u""",
    "local_names": """SELECT page_id, CASE WHEN contains(url, '#') THEN string_split(url, '#')[-1] ELSE string_split(rtrim(url, '/'), '/')[-1] END AS local_name, CAST(page_id AS INTEGER) AS article_number, CAST(NULL AS INTEGER) AS no_number FROM pages WHERE url IS NOT NULL""",
    "slug": r"SELECT p_partkey, lower(regexp_replace(regexp_replace(p_name || ' / ' || p_brand || ' / _', '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g')) AS slug FROM part",
    "arabic_only": rf"SELECT id, coalesce(trim(text) <> '' AND regexp_matches(text, '[\x{{0600}}-\x{{06FF}}]') AND NOT regexp_matches(text, '[A-Za-z]'), false) AS arabic_only FROM ({_ROWS})",
    "char_budget": "SELECT o_orderkey, CAST(least(2500, greatest(600, 12000 // greatest(o_orderkey % 30, 1))) AS INTEGER) AS budget FROM orders",
    "excerpts": r"SELECT doc_id, substr(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 1, 120) AS excerpt, source || ' ' || lang || ' hint' AS embedding_text FROM documents",
    "citation_extract": rf"""WITH {_ANSWERS}, f AS (SELECT l_orderkey, {_ints(r"regexp_extract_all(answer, '\[\s*المادة\s+([0-9٠-٩]+)\s*\]', 1)")} AS ci,
        {_ints(r"regexp_extract_all(answer, '(?:^|[^\p{L}\p{N}_\x{0600}-\x{06FF}])(?:المادة|مادة)\s+([0-9٠-٩]+)\s*\]*', 1)")} AS cm FROM answers)
        SELECT l_orderkey, {_LIST.format(_ordered('ci'))} AS inline, {_LIST.format(_ordered('ci'))} AS evaluated, {_LIST.format(_ordered('cm'))} AS mentioned FROM f""",
    "citation_repair": f"WITH {_ANSWERS} SELECT l_orderkey, {_REPAIRED} AS repaired FROM answers",
    "citation_state": f"WITH {_STATE} SELECT l_orderkey, {', '.join(_LIST.format(c) + ' AS ' + c for c in ('inline', 'valid_inline', 'final', 'invalid_inline', 'invalid_structured'))}, needs_retry FROM told",
    "answer_routing": f"""WITH {_STATE}, r AS (SELECT *, CASE WHEN l_orderkey % 7 = 0 THEN 'out_of_scope' WHEN len(allowed) = 0 THEN 'insufficient_evidence' ELSE 'draft' END AS route FROM told),
        bad AS (SELECT *, list_sort(list_distinct(list_concat(invalid_inline, invalid_structured))) AS b, route = 'draft' AND NOT needs_retry AS ok FROM r)
        SELECT l_orderkey, CASE WHEN route <> 'draft' THEN route WHEN ok THEN 'generated' ELSE 'insufficient_evidence' END AS status, ok AS grounded, CASE WHEN ok THEN {_LIST.format('final')} ELSE '' END AS cited,
          CASE WHEN ok THEN 'note' WHEN route = 'draft' THEN concat_ws(' ', CASE WHEN len(b) > 0 THEN 'Cited without having been retrieved: ' || array_to_string(b, ', ') END, CASE WHEN len(final) = 0 THEN 'No article is validly cited.' END, 'The second draft did not mend this.')
               WHEN route = 'insufficient_evidence' THEN 'None of the retrieved articles has a number and a text.' ELSE '' END AS warnings,
          CAST(CASE WHEN route = 'out_of_scope' THEN {len(answers.OUT_OF_SCOPE)} WHEN route = 'insufficient_evidence' THEN {len(answers.NO_EVIDENCE)} WHEN NOT ok THEN {len(answers.NOT_ACCEPTED)}
            ELSE length(trim(answer || CASE WHEN len(valid_inline) = 0 THEN ' ' || array_to_string(list_transform(final, lambda k: '[المادة ' || k || ']'), '') ELSE '' END)) END AS INTEGER) AS answer_length FROM bad""",
    "plan_validation": """WITH p AS (SELECT event_id, event_id % 97 AS k, (event_id % 97) % 7 AS n, value / 50 AS c, CASE WHEN event_type = 'error' THEN 'abstain' WHEN event_id % 97 = 13 THEN 'maybe' ELSE 'retrieve' END AS d FROM events)
        SELECT event_id, CASE WHEN d = 'maybe' THEN 'unknown_decision' WHEN c < 0 OR c > 1 THEN 'confidence_out_of_range' WHEN n > 5 THEN 'too_many_issues' WHEN d = 'abstain' AND n > 0 THEN 'abstain_with_issues' WHEN d = 'abstain' AND (k % 3 <> 0 OR k % 5 <> 0) THEN 'abstain_with_articles'
          WHEN d = 'abstain' THEN NULL WHEN n = 0 THEN 'retrieve_without_issues' WHEN k % 3 < 1 THEN 'minimum_below_one' WHEN k % 5 < k % 3 THEN 'maximum_below_minimum' WHEN k % 11 = 5 AND n >= 2 THEN 'article_number_leaked' END AS error, d = 'abstain' AND c >= 0.8 AS verify FROM p""",
    "selection_normalize": f"""WITH x AS (SELECT l_orderkey, list({{'n': CAST(l_partkey % 50 AS INTEGER), 'issue': CAST(l_suppkey % 6 AS INTEGER), 'covered': l_quantity > 10}} ORDER BY l_linenumber, l_partkey % 50, l_suppkey % 6, l_quantity > 10) AS x FROM lineitem GROUP BY l_orderkey),
        a AS (SELECT l_orderkey, x, list_transform(x, lambda e: e.n) AS n FROM x),
        b AS (SELECT *, CASE WHEN l_orderkey % 5 = 0 THEN CAST([] AS INTEGER[]) WHEN l_orderkey % 5 = 1 THEN n[1:3] ELSE n END AS cat, list_filter(x, lambda e, i: e.issue BETWEEN 1 AND 3 AND list_position(list_transform(x, lambda q: q.issue), e.issue) = i) AS firsts FROM a),
        c AS (SELECT *, len(list_filter(n[1:2], lambda v: NOT list_contains(cat, v))) > 0 OR len(list_filter(firsts, lambda e: NOT list_contains(cat, e.n) OR NOT list_contains(cat, n[1]))) > 0 AS foreign_, list_filter(firsts, lambda e: e.covered) AS held FROM b),
        e AS (SELECT *, list_concat(n[1:2], flatten(list_transform(held, lambda h: [h.n, n[1]]))) AS joined, flatten(list_transform(held, lambda h: [h.n, n[1]])) AS backed FROM c)
        SELECT l_orderkey, CASE WHEN len(cat) = 0 OR foreign_ THEN '' ELSE array_to_string(list_filter({_ordered('joined')}, lambda v: list_contains(backed, v))[1:5], ',') END AS selected,
          CASE WHEN len(cat) = 0 OR foreign_ THEN '' ELSE array_to_string(list_sort(list_transform(held, lambda h: h.issue)), ',') END AS covered, CASE WHEN len(cat) > 0 AND foreign_ THEN 'outside_catalogue' END AS error FROM e""",
    "rerank_payload": """WITH c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 12)
        SELECT o_custkey AS question_id, count(*) AS n_articles, CAST(1 + count(*) + sum(length('{"graph_rank":,"article_number":,"graph_score":,"text":""}') + length(CAST(rank AS VARCHAR)) + length(CAST(o_orderkey AS VARCHAR)) + length(CAST(round(floor(o_totalprice) / 1000, 6) AS VARCHAR)) + length(o_orderpriority)) AS INTEGER) AS payload_length FROM c GROUP BY o_custkey""",
    "strict_json": """SELECT event_id, CASE WHEN event_id % 10 NOT IN (3, 4, 5) THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE event_id % 10 WHEN 3 THEN 'unknown_keys' WHEN 4 THEN 'missing_keys' WHEN 5 THEN 'malformed' END AS error FROM events""",
}
