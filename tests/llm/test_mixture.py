from celldays.llm.mixture import counted, mix
from celldays.llm.tokens import codec, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, path string, n_tokens int, about string, _source string"


def test_counted_and_mixed(spark):
    long = "tokens of a text, " * 30
    rows = [(1, "a b c", "EN", " Src_A", "nb/fwi_12.ipynb"), (2, None, "deu", "src_a", "nb/x.ipynb"), (3, "", None, "SRC_A ", None), (4, long, "zh-CN", "src_b", "nb/aet_1.ipynb"), (4, long, "zh-CN", "src_b", "nb/aet_1.ipynb"), (5, "x", "??", None, "p"), (6, "x", "en", "other", "p"), (None, "d e", "fr_FR", "src_b", "fwi")]
    df = spark.createDataFrame([(*r, 7, "clash", "clash") for r in rows], DOCS)
    targets = spark.createDataFrame([("src_a", 0.1, 2, 100), ("src_b", 0.9, 1, 100)], "source string, target_weight double, max_repeat int, total_tokens long")
    size = lambda t: len(codec(tokenizer_path())[0].encode_ordinary(t or ""))
    tokens = counted(df, targets, ["fwi", "aet"], leaf=64)
    got = sorted(((r["doc_id"] or 0), r["source"], r["language"], r["topic"], r["n_tokens"]) for r in tokens.collect())
    assert got == sorted([(1, "src_a", "en", "fwi", size("a b c")), (2, "src_a", "de", "other", 0), (3, "src_a", "und", "other", 0), (4, "src_b", "zh", "aet", size(long)), (4, "src_b", "zh", "aet", size(long)), (0, "src_b", "fr", "fwi", size("d e"))])
    docs, report, _ = mix(tokens, targets)
    assert {r["source"]: r["unreachable"] for r in report.collect()} == {"src_a": True, "src_b": False}
    assert all(1 <= r["copies"] <= 2 and r["n_tokens"] > 0 for r in docs.collect())
    assert counted(df.limit(0), targets, ["fwi"]).count() == 0
