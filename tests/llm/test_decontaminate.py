import random

from folioscan.llm import decontaminate as D

from .conftest import words


def slow(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (p != c))
    return min(row)


def test_bit_parallel_distance_equals_the_table():
    r = random.Random(5)
    for _ in range(400):
        pattern = "".join(r.choice("abc") for _ in range(r.randint(1, 90)))
        text = "".join(r.choice("abcd") for _ in range(r.randint(0, 120)))
        found, end = D.distance(pattern, text, len(pattern))
        assert found == slow(pattern, text) and slow(pattern, text[:end]) == found


def edited(text, n, seed):
    r = random.Random(seed)
    out = list(text)
    for _ in range(n):
        i = r.randrange(len(out))
        kind = r.randrange(3)
        out[i : i + 1] = [] if kind == 0 else [r.choice("xyz")] if kind == 1 else [out[i], r.choice("xyz")]
    return "".join(out)


def test_finds_exactly_what_brute_force_finds(docs, spark):
    items = [(i, " ".join(words(18 + i, i))) for i in range(12)] + [(50, None), (51, "short one"), (52, "")]
    rows = [(1, None), (2, ""), (3, " ".join(words(300, 77)))]
    for i, text in items[:12]:
        budget = int(len(D.fold(text)) * 0.1)
        for k, n in enumerate((0, budget // 2, budget, budget + 6)):
            rows.append((100 * i + k + 10, " ".join(words(30, i + k)) + " " + edited(text.upper() if k else text, n, i) + "\n" + " ".join(words(20, i))))
    rows += [(9000, "here is a Short  ONE, see"), (9001, "here is a short ones, see"), (9999, rows[3][1] * 400)]
    bench = spark.createDataFrame(items + [items[0]], "item_id long, text string")
    want = {}
    for d, t in rows:
        for i, item in items:
            if item and t and d != 9999:
                best = slow(D.fold(item), D.fold(t))
                if i == 51 and best == 0 and "short one," not in D.fold(t):
                    continue
                if best <= (0 if i == 51 else int(len(D.fold(item)) * 0.1)):
                    want[d, i] = best
    found = D.find_contamination(docs(rows, item_id=1, distance=2), bench).collect()
    got = {(r.doc_id, r.item_id): r.distance for r in found if r.doc_id != 9999}
    assert got == want and len(want) >= 30
    assert [r.item_id for r in found if r.doc_id == 9999] == [0]
    assert want[9000, 51] == 0 and (9001, 51) not in want
    for r in found:
        text, item = D.fold(dict(rows)[r.doc_id]), D.fold(dict(items)[r.item_id])
        part = text[r.match_start : r.match_end]
        assert slow(item, part) == r.distance
    blocks = D.find_contamination(docs(rows), bench, block_chars=400)
    assert {(r.doc_id, r.item_id): r.distance for r in blocks.collect() if r.doc_id != 9999} == want
    kept = {r.doc_id for r in D.drop_contaminated(docs(rows), bench, block_chars=700).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want} - {9999}


def test_empty_tables_and_repeats(docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    text = " ".join(words(40, 1))
    assert D.find_contamination(docs([(1, text)]), none).collect() == []
    bench = spark.createDataFrame([(7, text)], "item_id long, text string")
    assert D.find_contamination(docs([]), bench).collect() == []
    assert len(D.find_contamination(docs([(1, text), (1, text), (None, text)]), bench).collect()) == 3
    assert D.drop_contaminated(docs([(1, text), (2, "fine")]), bench).columns == docs([]).columns


def test_anchored_distance_is_that_of_a_beginning():
    r = random.Random(6)
    for _ in range(200):
        pattern = "".join(r.choice("abc") for _ in range(r.randint(1, 40)))
        text = "".join(r.choice("abcd") for _ in range(r.randint(0, 60)))
        each = [distance_of_all(pattern, text[:i]) for i in range(len(text) + 1)]
        found, end = D.distance(pattern, text, len(pattern), anchored=True)
        assert (found, end) == (min(each), each.index(min(each)))


def distance_of_all(a, b):
    row = list(range(len(b) + 1))
    for i, p in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, c in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (p != c))
    return row[-1]


def test_long_items_and_repetitive_texts_cost_little():
    import time

    item = D.fold(" ".join(words(900, 3)))[:5000]
    matcher = D.Matcher([(1, item)], 0.1, D.WORDS_BELOW)
    began = time.process_time()
    for n in (0, 3, 100, 480):
        text = "before " + edited(item, n, n) + " after"
        (found,) = matcher.matches(text)
        assert found[1] <= n
    assert time.process_time() - began < 4
    began = time.process_time()
    (found,) = matcher.matches("x " + edited(item, 3, 1) + " y")
    assert time.process_time() - began < 1
    text = D.fold("of the " * 3000 + "of thee of the " * 500)
    matcher = D.Matcher([(2, D.fold("of the " * 60)), (3, D.fold("of the off " * 40))], 0.1, D.WORDS_BELOW)
    began = time.process_time()
    assert [(i, d) for i, d, _, _ in matcher.matches(text)] == [(2, 0)]
    assert time.process_time() - began < 5


def test_items_of_few_characters_have_their_budget(docs, spark):
    r = random.Random(9)
    pool = words(12, 4)
    items = [(i, " ".join(r.choice(pool) for _ in range(3))[: r.randint(8, 23)].strip()) for i in range(30)] + [(99, "what is the capital x")]
    rows = [(i, " ".join([" ".join(r.choice(pool) for _ in range(20)), edited(r.choice(items)[1], r.randint(0, 3), i), r.choice(["end", ", end", "end."])])) for i in range(60)]
    rows += [(100, "say what is the capital x now"), (101, "say what is the capitol x now"), (102, "say what is the cupitol x now"), (103, "say what is the cupitol xyz now"), (104, "somewhat is the capital x")]

    def best(item, text):
        most, found = len(item) // 10, []
        for s in range(len(text)):
            if s and text[s - 1].isalnum():
                continue
            for e in range(s + max(1, len(item) - most), min(len(text), s + len(item) + most) + 1):
                if not text[e : e + 1].isalnum():
                    found.append(distance_of_all(item, text[s:e]))
        return min(found, default=99)

    want = {(d, i): x for d, t in rows for i, item in items if (x := best(D.fold(item), D.fold(t))) <= len(D.fold(item)) // 10}
    found = D.find_contamination(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.distance for r in found} == want
    assert {d for d, i in want if i == 99 and d >= 100} == {100, 101, 102}


def test_cut_items_of_the_benchmark_in_all_documents(spark, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("item_id", "substring_index(text, ' ', 2 + item_id % 3) as text").where("length(text) between 8 and 23")
    texts = {r.doc_id: D.fold(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if r.text and len(r.text) < 6000}
    found = {(r.doc_id, r.item_id) for r in D.find_contamination(spark.read.parquet(f"{sf}/documents.parquet"), bench).collect() if r.doc_id in texts}
    items = {r.item_id: D.fold(r.text) for r in bench.collect()}
    for i, item in items.items():
        most = len(item) // 10
        for d, t in texts.items():
            near = D.distance(item, t, most)[0] <= most
            if near and (d, i) not in found:  # then no such place begins and ends where words do
                spans = [(s, e) for s in range(len(t)) if not (s and t[s - 1].isalnum()) for e in range(s + len(item) - most, min(len(t), s + len(item) + most) + 1) if not t[e : e + 1].isalnum()]
                assert all(D.edits(item, t[s:e]) > most for s, e in spans)
            assert near or (d, i) not in found
    assert found
