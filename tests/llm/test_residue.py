from lakeloom.llm import residue as R

WORDS = "relay cache index token ledger harbor signal window vector branch socket".split()


def _content(i):
    a, b = WORDS[i % 11], WORDS[(i * 7 + 3) % 11]
    return f"# Notes {i}\n\nThe {a} keeps a counter per {b} so that the loop can stop early. When a {b} turns stale, the {a} waits {i} ms before it looks again. Please keep the {a} small; the worker reads it on each {b}."


BAD = ["404 Not Found\n\nThe requested path /a/b was not found on this server.", "Please enable JavaScript to view this page.", "# Title\n\nLorem ipsum dolor sit amet bezat mim guzutir zum. Dolor sit vak temor.", "Menu\n\nAccess denied\nYou don't have permission to open /x/y.", "503 Service Unavailable\nTry again later.", "Content coming soon."]
HOLES = ["Dear {{ owner }}, your relay is ready.", "Hello ${user.name}, thank you.", "Contact [INSERT team HERE] when it stops.", "Hello undefined, your token is ready.", "See [object Object] for the relay."]
FINE = [_content(3) + "\n\nThe template writes `{{ user.name }}` where nothing was passed.", _content(4) + "\n\n```yaml\nname: {{ .Values.name }}\n```", _content(5) + "\n\nAn answer of 404 Not Found means that the chunk was removed.", "Please enable JavaScript to view this page.\n\n" + _content(6) + _content(7) + _content(8)]


def test_documents(spark):
    rows = [(i, _content(i)) for i in range(120)]
    bad = {1000 + i: t for i, t in enumerate(BAD * 3)}
    holes = {2000 + i: _content(i) + "\n\n" + t for i, t in enumerate(HOLES)}
    fine = {3000 + i: t for i, t in enumerate(FINE)}
    rows += [*bad.items(), *holes.items(), *fine.items(), (9000, None), (9001, ""), (9002, " \n ")]
    df = spark.createDataFrame([(k, v, True) for k, v in rows], "doc_id long, text string, residue boolean")
    got = {r["doc_id"]: r["residue"] for r in R.scored(spark, df).collect()}
    assert [k for k in (9000, 9001, 9002) if k in got] == []
    flagged = {k for k, v in got.items() if v}
    assert set(bad) <= flagged and set(holes) <= flagged
    assert not flagged & (set(fine) | set(range(120)))


def test_empty_and_without_positives(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert R.scored(spark, df).count() == 0
    df = spark.createDataFrame([(i, _content(i)) for i in range(20)], "doc_id long, text string")
    assert R.scored(spark, df).where("residue").count() == 0


def test_holes_in_long_sentences_lists_and_tables(spark):
    """A placeholder counts by the words around it, wherever in the prose it stands."""
    rows = [(i, _content(i)) for i in range(120)]
    rows += [(1000 + i, t) for i, t in enumerate(BAD * 3)] + [(2000 + i, _content(i) + "\n\n" + t) for i, t in enumerate(HOLES * 2)]
    long = "The relay keeps a counter per window so that the loop can stop early and the worker reads it on each branch, please contact {{ owner }} before you change how the signal reaches the socket and the cache, which waits before it looks again at the ledger and the vector index of the harbor."
    rows += [(3000, _content(1) + "\n\n" + long), (3001, _content(2) + "\n\n- first\n    - Dear {{ owner }}, ready.\n"), (3002, _content(3) + "\n\n| relay | owner |\n|---|---|\n| cache | Dear {{ owner }}, ready. |\n"), (3003, _content(4) + "\n\n| relay | cache |\n|---|---|\n| 1 | 2 |\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["residue"] for r in R.scored(spark, df.where("doc_id >= 0")).collect()}
    assert [got[k] for k in (3000, 3001, 3002, 3003)] == [True, True, True, False]
