from tidemark.llm import line_dedup


def test_repeated_rows_are_dealt_apart(spark, monkeypatch):
    """Many copies of one row (same id, same text) come in blocks of a bounded size, and all lose their frequent lines."""
    monkeypatch.setattr(line_dedup, "BLOCK_DOCS", 500)
    drop = line_dedup._drop

    def counted(docs, often):
        out = drop(docs, often)
        texts = out["text"].to_pylist()
        size = str(docs.num_rows)
        return out.set_column(out.column_names.index("text"), "text", [[t + "|" + size for t in texts]])

    monkeypatch.setattr(line_dedup, "_drop", counted)
    rows = spark.range(40_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'again\nand again' AS text").union(spark.range(9).selectExpr("id", "concat('own ', id, '\nagain\nrare') AS text"))
    out = line_dedup.drop_frequent_lines(rows).collect()
    assert len(out) == 40_009 and {r.n_dropped for r in out if r.doc_id is None} == {2}
    assert {r.text.split("|")[0] for r in out if r.doc_id is not None} == {f"own {k}\nrare" for k in range(9)}
    blocks = [int(r.text.split("|")[1]) for r in out]
    assert max(blocks) < 1000  # about 80 blocks of about 500 rows
