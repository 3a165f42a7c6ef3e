import json

from graph_fixture import TTL

from karst.__main__ import main


def test_commands(spark, tmp_path, capsys, monkeypatch):
    path = tmp_path / "law.ttl"
    path.write_text(TTL, encoding="utf-8")
    from karst import settings

    monkeypatch.setenv("ARTICLE_COUNT", "6")
    monkeypatch.setenv("NODE_TABLE", "cli_nodes")
    monkeypatch.setenv("EDGE_TABLE", "cli_edges")
    settings.get_settings.cache_clear()
    try:
        assert main(["inspect", str(path)]) == 0
        assert json.loads(capsys.readouterr().out)["article_count"] == 6
        assert main(["audit", str(path)]) == 0
        assert json.loads(capsys.readouterr().out)["unreachable_article_numbers"] == [3, 6]
        assert main(["create", "--reset"]) == 0
        assert json.loads(capsys.readouterr().out)["cli_nodes"]["created"]
        assert main(["ingest", str(path)]) == 1  # two articles are not reachable
        assert "not valid" in capsys.readouterr().err
        assert main(["check", str(path)]) == 0
        assert json.loads(capsys.readouterr().out)["cli_nodes"]["stored"] == 0
    finally:
        settings.get_settings.cache_clear()
        for t in ("cli_nodes", "cli_edges"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")
