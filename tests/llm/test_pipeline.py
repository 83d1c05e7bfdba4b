import corpus_pipeline
from quillmine.llm import mixing, nearcopies, packing, substring
from quillmine.llm.common import DOCUMENT_COLUMNS
from tests.llm.helpers import frame, odd_docs, rng, words_text

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "substring", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    marked = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    before = {r.doc_id for r in docs.collect()}
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    kept = {r.doc_id for r in clean.collect()}
    assert clean.columns == DOCUMENT_COLUMNS and kept <= before and len(before - kept) < 3 * len(marked) + 5
    unique = corpus_pipeline.drop_near_copies(spark, clean, SF)
    heads = {r.doc_id for r in unique.collect()}
    assert heads == {r.doc_id for r in nearcopies.keep_first(clean).collect()} < kept and unique.columns == DOCUMENT_COLUMNS
    cut = corpus_pipeline.drop_repeated_passages(spark, unique, SF)
    want = {r.doc_id: (r.kept if r.n_removed else r.text) for r in substring.remove_repeats(unique).collect()}
    assert {r.doc_id: r.text for r in cut.collect()} == want and cut.columns == DOCUMENT_COLUMNS
    mixed = corpus_pipeline.order_sources(spark, cut, SF)
    assert mixed.columns == DOCUMENT_COLUMNS and {r.doc_id for r in mixed.collect()} == heads
    packed = corpus_pipeline.pack_sequences(spark, mixed, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed.collect()}


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r.offset + r.length <= 2048 for r in rows)


def test_odd_rows(spark):
    docs = odd_docs(spark).select(*DOCUMENT_COLUMNS)
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, SF)
            assert rows.columns == DOCUMENT_COLUMNS
        corpus_pipeline.pack_sequences(spark, rows, SF).collect()


def test_mixing_stage_keeps_every_document(spark):
    r = rng(9)
    names = ["hot"] * 600 + [f"s{k % 5}" for k in range(400)]
    docs = frame(spark, [words_text(r, 8) for _ in names], lambda i: names[i])
    rows = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, SF).collect()
    assert sorted(x.doc_id for x in rows) == list(range(1000))
    last = max(k for k, x in enumerate(rows) if x.source != "hot") + 1
    assert abs((last - 400) / last - mixing.MOST_SHARE) < 0.04 and all(x.source == "hot" for x in rows[last:])


def test_the_mix_shows_in_the_sequences(spark):
    """In every run of sequences the sources have the target weights, as long as the mix lasts."""
    r = rng(10)
    names = ["hot"] * 1800 + [f"s{k % 5}" for k in range(1400)]
    docs = frame(spark, [words_text(r, r.randrange(3, 30)) for _ in names], lambda i: names[i]).repartition(5)
    mixed = corpus_pipeline.persist(dict(corpus_pipeline.STAGES)["mixing"](spark, docs, SF), "mixed")
    rows = packing.pack_documents_in_order(mixed, segment_rows=160).collect()
    assert sorted({x.doc_id for x in rows}) == list(range(3200))
    source = dict(enumerate(names))
    runs = {}
    for x in rows:
        runs.setdefault(x.sequence_id >> 32, set()).add(x.doc_id)
    assert sorted(runs) == list(range(20)) and all(len(d) == 160 for d in runs.values())
    seen = {}
    for k in range(12):  # 1,400 documents and their 600 of the hot source are the mix
        for d in runs[k]:
            seen[source[d]] = seen.get(source[d], 0) + 1
        for s, share in {"hot": 0.3, **{f"s{i}": 0.14 for i in range(5)}}.items():
            assert abs(seen[s] - share * 160 * (k + 1)) < 16 + 1
    assert all(source[d] == "hot" for k in range(13, 20) for d in runs[k])
    inside = {}
    for x in rows:
        inside.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in inside.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(inside) <= sum(x.length for x in rows) / 2048 + 2 * 20


def test_places_are_those_of_the_files(spark):
    docs = frame(spark, [f"t{i}" for i in range(500)]).orderBy("doc_id")
    for table in (docs, corpus_pipeline.persist(docs, "ordered")):
        assert [x.doc_id for x in packing.in_file_order(table).orderBy("__place").collect()] == list(range(500))
    assert packing.in_file_order(docs.limit(0)).count() == 0
