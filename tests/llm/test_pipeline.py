"""The corpus pipeline, stage by stage against brute force."""

import corpus_pipeline as C
from caderneta.llm import language_id, line_quality, near_copies, surrogates
from tests.llm.test_packing import verify

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        kept[name] = (docs.collect(), spark.read.parquet(str(tmp_path / name)).collect())
        docs = spark.read.parquet(str(tmp_path / name))

    before, after = kept["language_id"]
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet").filter(~language_id.held_out()))
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if language_id.predict_text(model, r["text"])[1] >= 0.5}

    before, after = kept["quality_rules"]
    m = {r["doc_id"]: line_quality.measures(r["text"]) for r in before}
    failed = {k for k, x in m.items() if x[0] < 10 or 100 * x[4] > 20 * x[0]}
    assert not failed & {r["doc_id"] for r in after} and failed

    before, after = kept["near_duplicates"]
    sets = {r["doc_id"]: near_copies.shingles(r["text"]) for r in before}
    stay = {r["doc_id"] for r in after}
    near = {(a, b) for a in sets for b in sets if a < b and near_copies.similarity(sets[a], sets[b]) >= 0.8}
    # Whoever goes has a near copy with a smaller id; nobody who stays has one who stays, but for the few that the index may miss.
    reach = {d: {a for a, b in near if b == d} | {b for a, b in near if a == d} for d in sets}
    assert all(reach[d] for d in sets if d not in stay)
    missed = [p for p in near if p[0] in stay and p[1] in stay]
    assert len(near) > 10 and len(missed) <= 0.1 * len(near)

    before, after = kept["personal_data"]
    texts = {r["doc_id"]: r["text"] for r in after}
    assert set(texts) == {r["doc_id"] for r in before}
    for r in before:
        found = surrogates.find(r["text"])
        assert (texts[r["doc_id"]] == r["text"]) == (not found)
        assert not any(r["text"][a:b] in texts[r["doc_id"]] for a, b, _, _ in found)

    verify(C.STAGES[-1][1](spark, docs, SF).collect(), texts, 2048)


def test_odd_tables(spark):
    base = "one quite ordinary sentence that has more than ten different words in it, see"
    data = [(1, base, "en", "a", 1), (1, base, "en", "a", 1), (None, base, "en", None, 1), (None, f"{base} here and there and elsewhere again", None, "a", 1),
            (5, None, None, None, None), (6, "", "en", "a", 0), (7, "1 2 3", "en", "a", 5)]
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, lang string, source string, n_chars long, row_key string")
    docs = df
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "None"]
    assert len(C.STAGES[-1][1](spark, docs, SF).collect()) == 2
    docs = df.limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
