import pytest
from pyspark.sql import functions as F

from quillon.functions import stem

# Examples of the published algorithm.
PAIRS = dict(
    caresses="caress", ponies="poni", cats="cat", feed="feed", agreed="agre", plastered="plaster", motoring="motor", sing="sing", conflated="conflat",
    hopping="hop", falling="fall", hissing="hiss", failing="fail", filing="file", happy="happi", sky="sky", relational="relat", conditional="condit",
    digitizer="digit", vietnamization="vietnam", operator="oper", triplicate="triplic", formalize="formal", hopeful="hope", goodness="good",
    revival="reviv", allowance="allow", adjustment="adjust", adoption="adopt", probate="probat", rate="rate", cease="ceas", controll="control", roll="roll",
)


@pytest.mark.parametrize("word", PAIRS)
def test_porter(word):
    assert stem.porter(word) == PAIRS[word]


def test_columns(spark):
    df = spark.createDataFrame([(["Ponies", "cats"], "T:the dog/cat isn't running at 5!"), (None, None)], "w array<string>, p string")
    rows = df.select(stem.stemmed(F.col("w")), stem.clean_phrase(F.col("p")), stem.clean_phrase(F.col("p"), stem=True)).collect()
    assert tuple(rows[0]) == (["poni", "cat"], "dog cat is not running 5", "dog cat is not run 5")
    assert tuple(rows[1]) == (None, None, None) or rows[1][0] is None


def test_ontology_xml(spark, tmp_path):
    from quillon.sources import tables

    (tmp_path / "o.owl").write_text(
        '<?xml version="1.0"?><rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s">'
        '<owl:Class rdf:about="u#Boy"><rdfs:subClassOf rdf:resource="u#Man"/><owl:disjointWith rdf:resource="u#Girl"/></owl:Class>'
        '<owl:Class rdf:about="u#Man"></owl:Class></rdf:RDF>'
    )
    got = {(r["s"], r["p"], r["o"]) for r in tables.ontology_xml(spark, str(tmp_path / "o.owl")).collect()}
    assert got == {("u#Boy", "rdf:type", "owl:Class"), ("u#Man", "rdf:type", "owl:Class"), ("u#Boy", "rdfs:subClassOf", "u#Man"), ("u#Boy", "owl:disjointWith", "u#Girl")}
