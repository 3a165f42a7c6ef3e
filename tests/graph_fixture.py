"""A small law of our own: six articles, concepts with all the shapes that the engine meets."""

PREFIX = """@prefix law: <http://example.org/law#> .
@prefix rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> .
PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#>
@prefix owl: <http://www.w3.org/2002/07/owl#> .
@prefix skos: <http://www.w3.org/2004/02/skos/core#> .
"""

TTL = (
    PREFIX
    + """
# classes, with a cycle
law:LegalConcept a owl:Class ; rdfs:subClassOf law:Loop .
law:Loop a owl:Class ; rdfs:subClassOf law:LegalConcept .
law:Right a owl:Class ; rdfs:subClassOf law:LegalConcept .
law:WageRight a owl:Class ; rdfs:subClassOf law:Right .
law:Person a owl:Class .
law:regulates a owl:ObjectProperty .
law:the_law a law:Law ; rdfs:label "قانون التجربة"@ar ; law:hasArticle law:article_1 , law:article_2 , law:article_3 , law:article_4 , law:article_5 , law:article_6 .
law:article_1 a law:Article ; rdfs:label "المادة 1"@ar ; rdfs:comment "يدفع الأجر خلال سبعة أيام من استحقاقه."@ar ; law:hasParagraph law:par_1 ; law:regulates law:wage .
law:article_2 a law:Article ; rdfs:label "المادة 2"@ar , "Article 2"@en ; rdfs:comment "للعامل إجازة سنوية مدتها 14 يوما."@ar .
law:article_3 a law:Article ; rdfs:label "المادة 3"@ar ; rdfs:comment "تعريف الأجر."@ar ; law:hasDefinition law:wage_definition .
law:article_4 a law:Article ; rdfs:label "المادة 4"@ar ; rdfs:comment "غرامة على تأخير الأجر."@ar .
law:article_5 a law:Article ; rdfs:label "المادة 5"@ar ; rdfs:comment "إجازة مرضية."@ar .
law:article_6 a law:Article ; rdfs:label "المادة 6"@ar ; rdfs:comment "أحكام ختامية."@ar .
law:par_1 a law:Paragraph ; rdfs:comment '''فقرة "أولى"
سطر ثان'''@ar .
law:wage_definition a law:Definition ; rdfs:label "تعريف"@ar ; law:defines law:wage .
law:wage a law:WageRight ; rdfs:label "الأجر"@ar , "wage"@en , " wage "@en , "salaire"@fr ; skos:altLabel "الراتب"@ar ; law:supportedByArticle law:article_1 , law:article_4 ; law:regulatedBy law:article_1 ; law:definedIn law:wage_definition .
law:delay a law:LegalConcept ; rdfs:label "تأخير الأجر"@ar ; law:supportedByArticle law:article_4 ; law:violatesRight law:wage .
law:leave a law:Right ; rdfs:label "الإجازة"@ar ; rdfs:comment "leave \\u0041"@en-GB ; law:supportedByArticle law:article_2 , law:article_5 .
law:sick a law:Right ; skos:altLabel "المرض"@ar ; law:regulatedBy law:article_5 ; law:hasCondition law:leave .
law:worker a law:Person ; law:hasRight law:wage , law:leave ; law:age 30 ; law:rate 1.5 ; law:big 1e3 ; law:active true ; law:code "x"^^law:Code .
law:worker law:hasRight law:wage .
"""
)
