"""Line deduplication against brute force on odd rows."""

import hashlib
from collections import defaultdict

from corvane.llm import lines

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, kept string, gone string, pos long, line string"
LONG = "This line is shared by many documents, Éric says so"


def brute(rows, least=40, documents=5):
    """(doc_id, kept, n_lines, n_dropped) by plain Python: ids are documents, None one of them."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda x: x.strip(BLANKS).translate(lower)
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    largest = {k: max(ids, key=lambda i: (i is not None, i or 0)) for k, ids in holders.items() if len(ids) >= documents and len(k) >= least}
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if key(x) not in largest or largest[key(x)] == i]
        out.append((i, "\n".join(kept), len(own), len(own) - len(kept)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "g", 1, "l") for i, t in rows], SCHEMA)


def check(spark, rows, **how):
    got = [tuple(r) for r in lines.dedup(frame(spark, rows), **how).select("doc_id", "kept", "n_lines", "n_dropped").collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, **how), key=repr)
    return got


def test_lines(spark):
    rows = [(i, f"own {i}\n{LONG if i % 2 else '  ' + LONG.upper().replace('É', 'É') + chr(9) + chr(13)}\n\nlast {i}\n") for i in range(8)]
    # Upper-case letters beyond A-Z are other letters.
    rows += [(20 + i, LONG.replace("É", "é")) for i in range(4)]
    # 39 code points are too few, 40 are enough, whatever their bytes.
    rows += [(30 + i, "é" * 39 + "\n" + "ü" * 40) for i in range(6)]
    # Copies, null and empty texts, missing ids, and several texts under one id, which is one document.
    rows += [(40, None), (41, ""), (42, "\n\n"), (None, LONG), (None, "x\n" + LONG), (None, None), (7, LONG + "\n" + LONG), (7, LONG + "\n" + LONG)]
    rows += [(50, "a" * 60)] * 9 + [(None, "b" * 60)] * 9 + [(60 + i, "c" * 60 + "\n" + "c" * 60) for i in range(4)]
    rows += [(70 + i, f"{'same start ' * 3000}{i}\n" + "d" * 100_000) for i in range(5)]
    got = check(spark, rows)
    assert sum(r[3] for r in got) > 15
    assert {r[1] for r in got if r[0] == 50} == {"a" * 60} and {r[1] for r in got if r[0] is None} >= {"b" * 60}
    check(spark, rows, least=5, documents=2)


def test_no_rows(spark):
    assert lines.dedup(frame(spark, [])).count() == 0
    assert lines.digest(frame(spark, [(1, None)])).first()["kept_sha256"] == hashlib.sha256(b"").hexdigest()


def test_frequent_and_other_lines_meet_alike(spark, monkeypatch):
    """Lines found by broadcast and by join, as all are frequent, some, or none."""
    rows = [(i, "\n".join(f"line {j} of a passage that goes round and round" for j in range(12) if i % (j + 1) == 0)) for i in range(40)]
    want = sorted(brute(rows), key=repr)
    for share in (1, 20, 1 << 40):
        monkeypatch.setattr(lines, "FREQUENT", share)
        got = [tuple(r) for r in lines.dedup(frame(spark, rows)).select("doc_id", "kept", "n_lines", "n_dropped").collect()]
        assert sorted(got, key=repr) == want


def test_many_lines_of_one_text(spark):
    """One text of 200,000 lines is put together in one go, not line by line against the dropped ones."""
    text = "\n".join(f"{i} is the number of a line that is long enough" for i in range(200_000))
    rows = [(i, text) for i in range(5)]
    got = {r["doc_id"]: (r["n_dropped"], len(r["kept"])) for r in lines.dedup(frame(spark, rows)).collect()}
    assert got == {**{i: (200_000, 0) for i in range(4)}, 4: (0, len(text))}
