import random

from celldays.llm.tokens import codec, encode, join_tree, leaves_of, tokenizer_path


def direct(text):
    return codec(tokenizer_path())[0].encode_ordinary(text)


def by_tree(text, leaf):
    enc, piece = codec(tokenizer_path())
    out, held, now = [], [], -1
    for p, part in [*leaves_of(text, leaf), (-2, "")]:
        if held and p != now:
            out += join_tree(held, piece)
            held = []
        now = p
        if p >= 0:
            held.append(piece.encode_ordinary(part))
        else:
            out += enc.encode_ordinary(part)
    return out


def test_tree_equals_direct_on_random_runs():
    rng = random.Random(5)
    alphabets = ["ab", "abcdefghij", "-=_", "风火林山湿度低", " \n\t", "aA1 .'-\n", "0123456789", "é́ñß", "'s'll a"]
    for n in range(300):
        text = "".join("".join(rng.choices(rng.choice(alphabets), k=rng.randint(1, 90))) for _ in range(rng.randint(1, 6)))
        for leaf in (1, 3, 8, 20):
            assert by_tree(text, leaf) == direct(text), (n, leaf, text)


def test_encode_rows(spark):
    long = "plain words, " * 40 + "风火" * 300 + " tail" + "-" * 500
    rows = [(1, "a text", 0), (2, None, 0), (3, "", 0), (4, long, 0), (4, long, 0), (None, long, 1), (None, "x", 1), (5, "<|endoftext|>", 0), (6, " \n", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(((r[0] or 0), r[1]) for r in encode(df, leaf=64).collect())
    assert got == sorted(((r[0] or 0), direct(r[1] or "")) for r in rows)
    counts = sorted(((r[0] or 0), r[1]) for r in encode(df, leaf=64, count=True).collect())
    assert counts == sorted(((r[0] or 0), len(direct(r[1] or ""))) for r in rows)
    assert encode(df.limit(0)).collect() == []


def test_same_ids_as_the_json_form():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    for x in ["naïve café's  déjà\r\n\tvu", "深い森 123", "<|endoftext|> a", "👩‍🚒🇲🇺"]:
        assert t.encode(x, add_special_tokens=False).ids == direct(x)
