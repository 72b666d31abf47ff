"""Documents bucketed by doc_id: the scoring plan needs no exchange."""

from lectio.plans import fixtures as fx
from lectio.session import scratch_path
from lectio.sources.layout import read_bucketed, write_bucketed
from lectio.streaming.scoring import score_batch
from tests.conftest import SF_SMALL


def _physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_documents_score_without_exchange(spark):
    docs = fx.documents(spark, SF_SMALL)
    lex = fx.lexicon_table(spark, SF_SMALL)  # stored table: a plain scan in the plan
    write_bucketed(docs, "lectio_docs_bucketed", scratch_path(spark, "docs-bucketed"), buckets=4)
    bucketed = read_bucketed(spark, "lectio_docs_bucketed")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # show the static plan
    try:
        scored = score_batch(bucketed, lex)
        plan = _physical(scored)
        got = sorted((r.doc_id, r.level) for r in scored.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert "Exchange hashpartitioning" not in plan
    want = sorted((r.doc_id, r.level) for r in score_batch(docs, lex).collect())
    assert got == want


def test_bucketed_morph_text_without_exchange(spark):
    from lectio.operators.morph import morph_text
    from lectio.operators.segment import sentences
    write_bucketed(fx.documents(spark, SF_SMALL), "lectio_docs_bucketed_m", scratch_path(spark, "docs-m"), buckets=4)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        an = fx.analyses_table(spark, SF_SMALL)
        b = morph_text(sentences(read_bucketed(spark, "lectio_docs_bucketed_m").select("doc_id", "text"), "clean"), an)
        plan = _physical(b)
        got = sorted(tuple(r) for r in b.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert "Exchange hashpartitioning" not in plan
    want = sorted(tuple(r) for r in morph_text(sentences(fx.documents(spark, SF_SMALL).select("doc_id", "text"), "clean"),
                                               an).collect())
    assert got == want
