import random

from folioscan.llm import tokens as T

from .conftest import words

EDITS = "array<struct<at:long,removed:long,added:string>>"


def apply(text, edits):
    text = text or ""
    for at, removed, added in edits or []:
        at = min(max(at or 0, 0), len(text))
        text = text[:at] + (added or "") + text[at + max(removed or 0, 0) :]
    return text


def texts(r):
    bits = [*words(40, 1), " ", "  ", "\n", "\n\n", "\t", "'s", "'ll", "123", "4.5", "é", "ñandú", "\U0001f600", "...", " '", "\x1c", " ", "-", "don't"]
    return [None, "", " ", "a", "x" * 3000, " " * 700, *("".join(r.choice(bits) + r.choice([" ", " ", ""]) for _ in range(r.randint(1, 400))) for _ in range(60))]


def test_counts_after_edits_equal_a_whole_count(spark):
    r = random.Random(9)
    encode = T.encoding(T.VOCABULARY).encode_ordinary
    rows = []
    for i, t in enumerate(texts(r)):
        n = len(t or "")
        edits = [(r.randint(0, n + 5), r.choice([0, 1, 3, 40, 600]), r.choice(["", " ", "x", "'s", " new words here", "\n", "y" * 900])) for _ in range(r.randint(0, 4))]
        rows.append((i, t, edits or None))
    rows.append((None, "null id", [(None, None, None)]))
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {EDITS}")
    for leaf in (16, 64, 512):
        out = T.apply_edits(T.token_trees(df, leaf_chars=leaf, keep=("edits",)), leaf_chars=leaf)
        out = out.withColumn("leaves", T.leaf_count(out.tree_chars)).collect()
        assert len(out) == len(rows)
        for got, (i, t, edits) in zip(sorted(out, key=lambda x: (x.doc_id is None, x.doc_id)), rows, strict=True):
            after = apply(t, edits)
            assert got.doc_id == i and got.text == after and got.n_chars == len(after)
            assert got.tokens_before == len(encode(t or "")) and got.n_tokens == len(encode(after)) == got.tree_tokens[1]
            for sums in (got.tree_chars, got.tree_tokens):
                assert all(sums[k] == sums[2 * k] + sums[2 * k + 1] for k in range(1, len(sums) // 2))
            assert got.tree_chars[1] == len(after) and got.leaves == len(T.Tree(got.tree_chars, got.tree_tokens).leaves())


def test_an_edit_encodes_its_surroundings_only():
    encode = T.encoding(T.VOCABULARY).encode_ordinary
    text = " ".join(words(20_000, 2))
    tree = T.build(text, encode)
    after, again = T.edit(text, tree, len(text) // 2, 5, " edit ", encode)
    assert tree.total == len(encode(after)) and again < 8 * T.LEAF_CHARS


def test_text_without_spaces_has_leaves_too():
    encode = T.encoding(T.VOCABULARY).encode_ordinary
    r = random.Random(4)
    for text in (
        "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/") for _ in range(40_000)),
        "".join(r.choice("function(){return}[];x=1,'s'") for _ in range(40_000)),
        "".join(r.choice("\u4e2d\u6587\u5b57\u7b26\u4e32") + r.choice(["", "", "", "\uff0c", "\u3002", "2024"]) for _ in range(20_000)),
        "".join(r.choice("\u0e01\u0e02\u0e32\u0e41\u0e19\u0e48") + r.choice(["", "", "", "7"]) for _ in range(20_000)),
    ):
        tree = T.build(text, encode)
        assert tree.total == len(encode(text)) and len(tree.leaves()) > len(text) / 600
        after, again = T.edit(text, tree, len(text) // 2, 9, "edit", encode)
        assert tree.total == len(encode(after)) and again < 8 * T.LEAF_CHARS


def test_cuts_are_safe_in_any_text():
    encode = T.encoding(T.VOCABULARY).encode_ordinary
    r = random.Random(14)
    bits = [*"aZ09'-_\u00e9\u00d7\u00f7 \n\t.\u4e2d\u3042\uff0c\u0e19\u0e48\u00bd\u2460\u4e00", "'s", "'ll", "'re", "  ", "''"]
    for _ in range(400):
        text = "".join(r.choice(bits) for _ in range(r.randint(1, 80)))
        assert T.build(text, encode, leaf_chars=1).total == len(encode(text))


def test_edits_write_few_nodes_also_where_leaves_split():
    encode, r, cost = T.encoding(T.VOCABULARY).encode_ordinary, random.Random(6), {}
    for n in (1_500, 24_000):
        text = " ".join(words(n, 2))
        tree = T.build(text, encode, leaf_chars=32)
        leaves, written = len(tree.leaves()), []
        for k in range(300):
            before = tree.touched
            at = r.randint(0, len(text)) if k % 2 else len(text) // 2  # half of them at one place
            text, _ = T.edit(text, tree, at, r.choice([0, 0, 3, 90]), r.choice(["", " x", " some new words that make a leaf of their own "]), encode, leaf_chars=32)
            written.append(tree.touched - before)
        assert tree.total == len(encode(text)) and len(tree.leaves()) != leaves
        cost[n] = sum(written) / len(written)
    assert cost[24_000] < 3 * cost[1_500] and cost[24_000] < 0.05 * tree.width


def test_edges(spark):
    odd = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "a b", None)], "doc_id long, text string, keep string")
    assert sorted((r.doc_id or 0, r.text, r.keep, r.n_tokens, r.n_chars) for r in T.token_trees(odd, keep=("keep",)).collect()) == [(0, "a b", None, 2, 3), (1, None, "x", 0, 0), (1, None, "x", 0, 0)]
    assert T.token_trees(spark.createDataFrame([], "doc_id long, text string")).collect() == []
