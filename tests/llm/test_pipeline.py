import corpus_pipeline
from larder.llm import toxicity
from larder.llm.common import table

from . import brute
from .test_operators import SF, check_pieces


def test_pipeline_against_plain_stages(spark):
    check_stages(spark, table(spark, SF, "documents"))


def test_pipeline_on_odd_documents(spark, odd):
    """Nulls, empties, ties, repeated texts and columns named like those that the stages use inside."""
    clash = ["doc", "mark", "row", "keep", "kept_text", "n_lines", "k", "bucket", "_text", "n_words", "start", "label"]
    rows = [(i, t, "en", "src", len(t or ""), *["x"] * len(clash)) for i, (_, t) in enumerate(odd)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)
    check_stages(spark, spark.createDataFrame(rows, kinds).repartition(3))
    none = spark.createDataFrame([], kinds)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, none, SF).count() == 0


def check_stages(spark, docs):
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    rejected = {r["doc_id"] for r in toxicity.score(docs, toxicity.fit(docs, table(spark, SF, "labels"))).where("rejected").collect()}
    rows = {d: t for d, t in rows.items() if d not in rejected}
    stage = docs
    name, f = corpus_pipeline.STAGES[0]
    stage = f(spark, stage, SF)
    assert stage.columns == docs.columns and {r["doc_id"] for r in stage.collect()} == set(rows)
    rows = {d: t or "" for d, t in rows.items()}

    first = {}
    key = lambda x: brute.lower(k) if len(k := x.strip(" \t\n\v\f\r")) >= 10 else None
    for d in sorted(rows):
        for line in rows[d].split("\n"):
            first.setdefault(key(line), d)
    rows = {d: "\n".join(x for x in t.split("\n") if key(x) is None or first[key(x)] == d) for d, t in rows.items()}
    stage = corpus_pipeline.STAGES[1][1](spark, stage, SF)
    assert stage.columns == docs.columns and {r["doc_id"]: r["text"] for r in stage.collect()} == rows
    assert all(r["n_chars"] == len(r["text"]) for r in stage.collect())

    keep = {d for d, _, c in brute.jaccard(sorted(rows.items())) if d == c}
    rows = {d: t for d, t in rows.items() if d in keep}
    stage = corpus_pipeline.STAGES[2][1](spark, stage, SF)
    assert stage.columns == docs.columns and {r["doc_id"] for r in stage.collect()} == set(rows)

    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    gone = {x[0] for x in brute.decontaminate(sorted(rows.items()), items) if x[-1]}
    rows = {d: t for d, t in rows.items() if d not in gone}
    stage = corpus_pipeline.STAGES[3][1](spark, stage, SF)
    assert stage.columns == docs.columns and {r["doc_id"] for r in stage.collect()} == set(rows)

    check_pieces(corpus_pipeline.STAGES[4][1](spark, stage, SF).collect(), sorted(rows.items()))


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "decontaminate", "packing"]
