"""The index of a decontamination takes whole texts in small batches, and the session's own setting comes back."""

from lexiphyte.llm import decontamination

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_index_takes_small_batches(spark, monkeypatch):
    before, seen, stored = spark.conf.get(KEY), {}, decontamination.stored
    monkeypatch.setattr(decontamination, "stored", lambda df, label: seen.update({label: int(spark.conf.get(KEY))}) or stored(df, label))
    docs = spark.createDataFrame([(1, "One two three, four five six seven eight nine."), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([("a", "two THREE four five six seven eight nine"), ("b", "six seven")], "item_id string, text string")
    found = decontamination.contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "contaminated").collect()
    assert sorted(map(tuple, found)) == [(1, 9, 8, 2, True), (2, 0, 0, 0, False)]
    assert seen["postings"] == 1_000
    assert spark.conf.get(KEY) == before
