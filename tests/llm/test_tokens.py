import pytest
from pyspark.sql import functions as F

from lakeloom.llm import mixing, tokens

TEXTS = {1: "Hello world, it's <|endoftext|> fine\n\n  x\t y", 2: None, 3: "", 4: "   ", 5: "日本語 naïve 🚀🇩🇪  　 z", 6: "a" * 3000 + " " * 50 + "\r\n", 7: "don't WE'LL i'm 12345 1٢٣ ﬁ ½", 8: "Hello world, it's"}


def _expected():
    tk = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    tk.encode_special_tokens = True
    return {k: tk.encode(v or "", add_special_tokens=False).ids for k, v in TEXTS.items()}


@pytest.mark.parametrize("limit", [400_000, 3, 0])
def test_ids(spark, limit):
    df = spark.createDataFrame([(k, v, 9) for k, v in TEXTS.items()], "doc_id long, text string, ids int")
    want = _expected()
    assert {r["doc_id"]: list(r["ids"]) for r in tokens.encode(spark, df, limit=limit).collect()} == want
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(spark, df, limit=limit).collect()} == {k: len(v) for k, v in want.items() if v}


def test_decode_round_trip(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    back = tokens.decode(tokens.encode(spark, df), tokens.piece_table(spark))
    assert {r["doc_id"]: bytes(r["bytes"]).decode() for r in back.collect()} == {k: v for k, v in TEXTS.items() if v}


def test_empty(spark):
    assert tokens.encode(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mix(spark):
    docs = spark.createDataFrame(
        [(i, f"word number {i} " * (1 + i % 5), " Big " if i % 2 else "BIG", "en", "a-api", i) for i in range(200)] + [(200 + i, "some small text here " * 3, "small", "de", "b-docs", 1) for i in range(20)] + [(500, "x", "unlisted", "en", None, 1), (501, None, "small", None, None, 1), (502, "t", None, None, None, 1)],
        "doc_id long, text string, source string, lang string, repo_name string, copies int",
    )
    targets = spark.createDataFrame([("big", 0.5, 2), ("Small", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mix(spark, docs, targets)
    rows = {r["source"]: r for r in report.collect()}
    assert rows["small"]["most_copies"] == 3 and rows["none"]["tokens"] == 0
    assert rows["small"]["tokens"] == 3 * rows["small"]["source_tokens"]  # the cap binds
    total = sum(r["tokens"] for r in rows.values())
    assert abs(total / sum(r["source_tokens"] for r in rows.values()) - 1) < 0.02
    assert all(abs(r["reached_share"] - r["feasible_share"]) < 0.01 for r in rows.values())
    assert mix.agg(F.max("copies")).first()[0] <= 3 and mix.count() == mix.select("doc_id").distinct().count()


def test_letters_newer_than_the_jvm(spark):
    """Letters and numbers of Unicode 14 to 15, and all planes at their block starts."""
    import tiktoken

    own = tokens.encoding("byte_bpe_50k", tokens.TOKENIZERS)
    gpt = tiktoken.Encoding("full", pat_str=r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=own._mergeable_ranks, special_tokens={})
    texts = ["".join(f" a{chr(p)}b{chr(p + 1)}1 {chr(p)}" for p in range(lo, min(lo + 0x4000, 0x110000), 97) if not 0xD7F0 <= p < 0xE000) for lo in range(1, 0x110000, 0x4000)]
    texts += ["x\U0001DF00y \U00031350z \U00011F02! \U0001D2C0 5\U00011F50"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode(spark, df).collect()}
    assert all(got[i] == gpt.encode_ordinary(t) for i, t in enumerate(texts))


def test_one_look_finds_texts_with_unknown_letters(spark):
    """p8_ids: ordinary texts beyond ASCII were searched twice, the second time through a class of hundreds of ranges."""
    pattern, odd, above = tokens.word_patterns(spark)
    one = tokens.words(F.col("text"), spark)._jc.toString()
    assert not odd or one.count("rlike(") == 1
    texts = ["naïve — “quoted” text, 数字 ५६ it's", "plain text's end  ", "ᲊꟋ 𐵊a ꟽb’s 𞓰3x", "aࡰb ⿼㇯ 𮯰𠀀"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = df.select("i", "text", tokens.words(F.col("text"), spark).alias("w"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("all")).collect()
    assert len(got) == 4 and all("".join(r["w"]) == r["text"] and r["w"] == r["all"] for r in got)
