"""Pasted want lists in every form, against Python's csv and a plain loop."""

import csv
import io
import random

from soundlake.sources import files


def test_tables_against_a_reader(spark):
    rng = random.Random(4)
    cell = lambda: "".join(rng.choice(["a", "b", ",", '"', "\n", " ", "é", "'", "x"]) for _ in range(rng.randint(0, 6)))
    texts, want = [], {}
    for k in range(150):
        table = [[cell() for _ in range(rng.randint(1, 4))] for _ in range(rng.randint(1, 8))]
        out = io.StringIO()
        csv.writer(out, quoting=rng.choice([csv.QUOTE_ALL, csv.QUOTE_MINIMAL]), lineterminator=rng.choice(["\n", "\r\n"])).writerows(table)
        text = out.getvalue().rstrip("\r\n")
        texts.append((k, text))
        want[k] = list(csv.reader(io.StringIO(text, newline="")))
    got = {}
    for r in files.csv_rows(spark.createDataFrame(texts, "list_id long, text string")).orderBy("list_id", "row").collect():
        got.setdefault(r.list_id, []).append(r.cells)
    assert {k: [[c.replace("\r\n", "\n") for c in row] or [""] for row in rows] for k, rows in want.items()} == got


def plain(text):
    """A table's rows by a loop over characters: a quote toggles, a doubled one inside stands for itself."""
    rows, row, cell, quoted, i = [], [], "", False, 0
    while i < len(text):
        c = text[i]
        if quoted and c == '"' and text[i + 1 : i + 2] == '"':
            cell += '"'
            i += 1
        elif c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            row, cell = [*row, cell], ""
        elif c == "\n" and not quoted:
            rows, row, cell = [*rows, [*row, cell]], [], ""
        else:
            cell += c
        i += 1
    return [*rows, [*row, cell]]


def test_broken_tables_against_a_loop(spark):
    rng = random.Random(9)
    texts = [(k, "".join(rng.choice('ab,"\n"') for _ in range(rng.randint(1, 30)))) for k in range(300)]
    got = {}
    for r in files.csv_rows(spark.createDataFrame(texts, "list_id long, text string")).orderBy("list_id", "row").collect():
        got.setdefault(r.list_id, []).append(r.cells)
    assert got == {k: plain(t) for k, t in texts}


def test_every_form_in_one_table(spark):
    texts = [
        ("m", "#EXTM3U\n#EXTINF:210,An Artist - A Title\nx.mp3\nSome%20One - Thing.mp3\n"),
        ("c", ' Position,"Artist Name(s)",Track Name \r\n1,"One, Two","Everything, ""Everything"""\r\n2,,"Two\nlines"\r\n3,X,\r\n'),
        ("l", "# remark\nArtist, with comma - Title, too\n\nOnly a title\n"),
        ("1", "title\njust lines"),
        ("n", None),
        ("b", " \n "),
    ]
    got = {}
    for r in files.wants_of(spark.createDataFrame(texts, "list_id string, text string")).orderBy("list_id", "ord").collect():
        got.setdefault(r.list_id, []).append((r.artist, r.title))
    assert got == {
        "m": [("An Artist", "A Title"), ("Some One", "Thing")],
        "c": [("One", 'Everything, "Everything"'), (None, "Two\nlines")],
        "l": [("Artist, with comma", "Title, too"), (None, "Only a title")],
        "1": [(None, "title"), (None, "just lines")],
    }
