from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import pieces as P


def _check(text, limit=P.LIMIT, overlap=P.OVERLAP):
    data = text.encode()
    parts = P.pieces(text, limit, overlap)
    assert b"".join(data[a:b] for a, b, _ in parts) == data
    for i, (a, b, piece) in enumerate(parts):
        raw = piece.encode()
        assert len(raw) <= limit
        if i:
            k = len(raw) - (b - a)
            assert overlap - 3 <= k <= overlap and data[:a].endswith(raw[:k])
    return parts


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n.é日🚀{}(),"), max_size=1500))
def test_round_trip(text):
    _check(text, 100, 16)


def test_shapes():
    for t in ("", "x" * 20_000, "é" * 9000, "word " * 5000, "日本。" * 4000, "a" * 5121, "\n" * 8000):
        _check(t)
    assert len(P.pieces("a" * 5120)) == 1


def test_cuts_between_definitions():
    text = "".join(f"def f{i}(x):\n" + "    y = x + 1\n" * 60 + "\n" for i in range(12))
    for a, _, _ in _check(text)[1:]:
        assert text.encode()[a:].startswith(b"def ")


def test_split_table(spark):
    rows = [("chunks", "a", "w " * 4000), ("chunks", "a", "w " * 4000), ("chunks", "b", None), ("chunks", "c", ""), ("large_chunks", "a", "z" * 6000), ("chunks", "d", "short")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "source_table string, id string, content string, piece int")
    got = P.split(df).collect()
    assert {(r["source_table"], r["id"]) for r in got} == {("chunks", "a"), ("large_chunks", "a")}
    assert len({(r["source_table"], r["id"], r["piece_no"]) for r in got}) == len(got)
    assert P.split(df.limit(0)).count() == 0
