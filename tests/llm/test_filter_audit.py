"""Operator 11 against plain Python over all documents."""

import itertools
import random

import pytest
import xxhash

from simigraph.llm import filter_audit

DOCUMENTS, LABELS = "doc_id long, text string, source string, part string, mask int, n long", "doc_id long, quality int, toxic int, good int"


def fails(text):
    words = text.split(" ")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    a, b = len(words) < 200, 100 * len(set(words)) < 50 * len(words)
    return [a, b, 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), any(c in "#$%&*|" for c in text)]


def by_force(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *flags in labels if flags[k] == 1 and i is not None} for k in (0, 1))
    out = {}
    failed = [(s or "", i, fails(t or "") + [i is not None and least[t or ""] < i]) for i, t, s in rows]
    for part in {s for s, *_ in failed}:
        mine = [(i, f) for s, i, f in failed if s == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                k = "ABCDE".index(letter)
                gone = [x for x in left if x[1][k]]
                left = [x for x in left if not x[1][k]]
                redundant = sum(f[k] for _, f in mine) - len(gone)
                unique = sum(f[k] and sum(f) == 1 for _, f in mine)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, unique, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    for (part, order, step), v in out.items():
        v.append(sum(x[1] for (p, o, s), x in out.items() if p == part and o[s - 1] == order[step - 1]))
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    words = lambda n, kinds: " ".join(rnd.choice("abcdefg") * rnd.randint(1, 3) + str(rnd.randint(0, kinds)) for _ in range(n))
    texts = [words(rnd.choice([3, 199, 200, 300]), rnd.choice([2, 500])) + rnd.choice(["", "", " #", " ABCDEFGHIJKLMNOP" * 3, "\x0b|", "\u2003é 漢"]) for _ in range(60)]
    out = [(i, rnd.choice(texts), rnd.choice(["s0", "s1", None, ""])) for i in range(150)]
    out += [(1000 + i, texts[0], "hot") for i in range(80)]  # one text, a third of all rows
    return out + [(5, None, "s0"), (6, "", "s0"), (7, "", None), (None, texts[1], "s1"), (None, None, None), (9, texts[2], "s0"), (9, texts[2], "s0"), (9, texts[3], "s1"), (9, texts[2], "s1"), (2, texts[4], "x"), (2, texts[4], "x"), (1, texts[4], "y"), (8, "AB", "long"), (10, "w x " * 100_000, "long")]


def check(spark, rows, labels, parts=7):
    docs = spark.createDataFrame([(*r, "p", 1, 2) for r in rows], DOCUMENTS).repartition(parts)
    found = filter_audit.audit(docs, spark.createDataFrame([(*x, 1) for x in labels], LABELS)).collect()
    want = by_force(rows, labels)
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in found}
    assert len(got) == len(found) == len(want)
    assert got == want


def test_audit_equals_brute_force(spark, rows):
    rnd = random.Random(2)
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in rnd.choices(range(1100), k=500)] + [(None, 1, 1), (9, 1, 0), (9, 0, 1)]
    check(spark, rows, labels)


def test_colliding_fingerprints_and_full_tables(spark, rows, monkeypatch):
    """A chain of all texts, and a table that is sent on after each text."""
    kept = list(itertools.chain.from_iterable(filter_audit.firsts([(i, s or "", bytearray((t or "").encode())) for i, t, s in rows[k::3] if i is not None]) for k in range(3)))
    monkeypatch.setattr(filter_audit, "KEEP_BYTES", 1)
    each = list(filter_audit.firsts([(i, s or "", bytearray((t or "").encode())) for i, t, s in rows if i is not None]))
    want = sorted(x for x in filter_audit.chains(sorted(kept, key=lambda r: r[0])))
    for routed in (each, [(1, v) for _, v in each], [(1, v) for _, v in kept]):
        total = {}
        for d, p, m, n in filter_audit.chains(sorted(routed, key=lambda r: r[0])):
            total[d, p, m] = total.get((d, p, m), 0) + n
        assert total == {k: sum(x[3] for x in want if x[:3] == k) for k in {x[:3] for x in want}}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    assert sum(x[3] for x in want) == sum(i is not None and least[t or ""] < i for i, t, _ in rows)


def test_masks_at_their_limits():
    rnd = random.Random(9)
    texts = ["A" + "b" * 49, "A" + "b" * 48, "A" + "é" * 49, "A" + "é" * 48, "a " * 199, "a " * 200, "a b " * 100, "a b c d " * 50, "\u00a0".join("abc"), "a\x1cb", "É" * 10, "%", "", "&\n"]
    texts += ["".join(rnd.choice("aB é\u3000\x0b\n" + "cdefgh" * rnd.randint(1, 20)) for _ in range(rnd.randint(1, 900))) for _ in range(300)]
    for t in texts:
        assert filter_audit.mask_of(t.encode()) == sum(f << k for k, f in enumerate(fails(t))), t


def test_empty_tables(spark, rows):
    check(spark, [], [])
    check(spark, rows[:20], [])


def test_a_hot_text_leaves_a_partition_once():
    routed = list(filter_audit.firsts((i, "s", bytearray(b"same")) for i in range(1000)))
    assert sum(r[1][0] is not None for r in routed) == 1 and len(routed) == 1000
    assert len({r[0] % 16 for r in routed}) == 16 and routed[-1][0] == xxhash.xxh64_intdigest(b"same")
