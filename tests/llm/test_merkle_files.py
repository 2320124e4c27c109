"""What a manifest writes: files by its rows, not by the number of shuffle partitions."""

from ledgerloom.llm import merkle


def test_small_levels_make_few_files(spark, monkeypatch):
    settings = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    files, write = {}, merkle.materialise

    def spy(df, name):
        out = write(df, name)
        files.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(merkle, "materialise", spy)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = spark.range(3000).selectExpr("id AS doc_id", "'s' AS source", "CASE WHEN id % 3 > 0 THEN 'en' END AS lang", "id AS n_chars", "concat('Text ', id) AS text")
        out = merkle.verify(df)
        assert out.rdd.getNumPartitions() == 2
        rows = out.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert files == {"level": [1, 1, 1, 1], "subroots": [1], "top": [1]}
    assert len(rows) == 3000 and len({r.root for r in rows}) == 1
    untouched = merkle.verify(df)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, untouched.collect()))
