import hashlib
import unicodedata

from folioscan.llm import fingerprints as P


def form(t):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold()).split())


def check(df, rows):
    found = {r.doc_id: r for r in P.edit_check(df).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    groups = {}
    for d, t in rows:
        groups.setdefault(form(t), []).append(d)
    assert len(found) == len(rows)
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        r = found[d]
        assert (r.n_chars, r.edited_sha256, r.group_id) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), min(groups[form(t)]))
        assert (r.near_edited, r.near_next) == (float(form(t) == form(edited)), float(form(t) == form(after)))
        assert r.fingerprint == P.fingerprint(t) and r.edited_fingerprint == P.fingerprint(edited)
    return found


ODD = [(1, None), (2, ""), (3, "Straße  ﬁne"), (4, "STRASSE fine\n"), (7, "é"), (8, "é"), (9, "a" * 400_000), (12, "ab"), (13, "A\tB c"), (14, "a b C"), (-5, "negative"), (1 << 50, "large")]


def test_odd_texts(docs):
    found = check(docs(ODD, packed=1, part=2, tail=True), ODD)
    assert found[3].fingerprint == found[4].fingerprint and found[7].fingerprint == found[8].fingerprint
    assert found[1].group_id == found[2].group_id == 1


def test_many_ranges(docs, monkeypatch):
    monkeypatch.setattr(P, "ROWS_PER_RANGE", 7)
    rows = [(i * 3 % 1009, f"text {i % 50} " * (i % 9)) for i in range(200)]
    check(docs(rows), rows)


def test_single_row_empty_table_and_repeats(docs):
    check(docs([(5, "only one row")]), [(5, "only one row")])
    assert P.edit_check(docs([])).collect() == []
    rows = P.edit_check(docs([(5, "same"), (5, "same"), (None, "x"), (4, "z")])).collect()
    assert len(rows) == 4 and sorted(r.near_next for r in rows) == [0.0, 0.0, 0.0, 1.0]


def test_exact_groups(docs):
    rows = ODD + [(20, "STRASSE FINE")]
    got = {r.doc_id: r.group_id for r in P.exact_groups(docs(rows)).collect()}
    groups = {}
    for d, t in rows:
        groups.setdefault(form(t), []).append(d)
    assert got == {d: min(groups[form(t)]) for d, t in rows}


def test_a_collision_parts_again(spark):
    rows = spark.createDataFrame([(1, "f", b"a"), (2, "f", b"b"), (3, "f", b"a"), (4, "g", b"a")], "doc_id long, fingerprint string, packed binary")
    assert {r.doc_id: r.group_id for r in P.groups_of(rows).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
