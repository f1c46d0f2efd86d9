"""Operators 2, 3, 4, 5, 6, 8, 9 and the pipeline against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from simigraph.llm import lattice_lm, line_dedup, line_rules, lz_fingerprint, packing, shingle_join, simhash, token_files, url_tree
from simigraph.llm.queries import PIECES, WORD_BPE, words_and_end

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(rnd, n):
    return " ".join(rnd.choice("abcdefghij") + rnd.choice("klmnopqrst") + str(rnd.randint(0, 60)) for _ in range(n)) + "."


# 2


def test_packing_keeps_everything_and_fits(documents, odd):
    rnd = random.Random(1)
    docs = documents([(i, sentence(rnd, rnd.randint(1, 9000 if i % 9 == 0 else 700))) for i in range(200)])
    rows = packing.pack_documents(docs, words_and_end(), group_pieces=50).collect()
    size = {r.doc_id: len(WORDS.findall(r.text)) + 1 for r in docs.collect()}
    got, bins = Counter(), {}
    for r in rows:
        got[r.doc_id] += r.n_tokens
        bins.setdefault(r.bin, []).append(r)
    assert got == Counter(size)
    for members in bins.values():
        used = sum(m.n_tokens for m in members)
        at = 0
        for m in sorted(members, key=lambda m: m.offset):
            assert m.offset == at
            at += m.n_tokens
        assert used == members[0].bin_used <= members[0].bin_length
        assert members[0].bin_length == min((x for x in packing.LENGTHS if x >= used), key=packing.cost)
    assert packing.pack_documents(odd, words_and_end()).where("doc_id is null").count() == 2
    assert packing.pack_documents(odd.limit(0), words_and_end()).count() == 0


def test_sequences_hold_the_ids_of_all_documents(spark, odd, tmp_path):
    """Texts to ids, ids to files, files to sequences, sequences written and read back."""
    rnd = random.Random(2)
    more = spark.createDataFrame([(100 + i, sentence(rnd, rnd.randint(1, 2500)), "en", "s", 0) for i in range(30)], odd.schema)
    token_files.write_token_files(odd.union(more), f"file://{tmp_path}/ids", WORD_BPE, 1)
    tokens = token_files.read_token_files(spark, f"file://{tmp_path}/ids")
    packing.pack_sequences(tokens, group_pieces=20).write.parquet(f"file://{tmp_path}/sequences")
    back, found = spark.read.parquet(f"file://{tmp_path}/sequences").collect(), {}
    for r in back:
        assert len(r.ids) == r.bin_used <= r.bin_length and r.bin_length in packing.LENGTHS
        at = 0
        for p in r.pieces:
            assert p.offset == at
            at += p.n_tokens
            found.setdefault(p.doc_id, []).append((p.first, r.ids[p.offset : p.offset + p.n_tokens]))
        assert at == r.bin_used
    want = {}
    for r in tokens.collect():
        want.setdefault(r.doc_id, []).append(list(r.ids))
    assert set(found) == set(want)
    for doc, lists in want.items():
        pieces = sorted(found[doc], key=lambda p: p[0])
        assert sorted(x for _, ids in pieces for x in ids) == sorted(x for ids in lists for x in ids)
        if len(lists) == 1:
            assert [x for _, ids in pieces for x in ids] == lists[0]
    empty = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {p.doc_id for r in packing.pack_sequences(empty).collect() for p in r.pieces} == {1, 2}
    assert packing.pack_sequences(empty.limit(0)).count() == 0


def plain_plan(sizes, lengths, price, preferred):
    """Best fit with lists and plain searches; the trial fills a length piece by piece."""
    least = lambda used: min((x for x in lengths if x >= used), key=lambda x: (price(x), x))
    bins = []
    for k, s in enumerate(sizes):
        fits = [b for b in bins if b[0] - sum(b[1]) >= s]
        if fits:
            room = min(b[0] - sum(b[1]) for b in fits)
            next(b for b in reversed(bins) if b[0] - sum(b[1]) == room)[1].append(s)
            continue
        able = [x for x in lengths if x >= s]
        if preferred is not None:
            length = max(able[0], preferred)
        else:
            rated = []
            for x in able:
                held = s
                for t in sizes[k + 1 :]:
                    if held + t <= x:
                        held += t
                rated.append((price(least(held)) / held, x))
            length = min(rated)[1]
        bins.append([length, [s]])
    return sum(price(least(sum(b[1]))) for b in bins), sorted(tuple(b[1]) for b in bins), {b[0] for b in bins}


def cheapest(sizes, lengths, price):
    """By trying all ways to part the pieces."""
    if not sizes:
        return 0.0
    best, rest = math.inf, sizes[1:]
    for mask in range(1 << len(rest)):
        used = sizes[0] + sum(s for k, s in enumerate(rest) if mask >> k & 1)
        if used <= max(lengths):
            cost = min(price(x) for x in lengths if x >= used)
            best = min(best, cost + cheapest([s for k, s in enumerate(rest) if not mask >> k & 1], lengths, price))
    return best


def test_packing_equals_plain_best_fit():
    rnd, lengths = random.Random(2), (16, 32, 64)
    price = lambda x: 4 + x + x * x / 128
    opened = set()
    for n in (1, 2, 7, 40, 150):
        sizes = sorted((rnd.randint(1, 60) if rnd.random() < 0.3 else rnd.randint(1, 15) for _ in range(n)), reverse=True)
        plans = {preferred: plain_plan(sizes, lengths, price, preferred) for preferred in (None, *lengths)}
        opened |= plans[None][2]
        for preferred, (cost, members, _) in plans.items():
            bins, offsets, final = packing.plan(sizes, lengths, price, preferred)
            got = [tuple(s for s, k in zip(sizes, bins, strict=True) if k == b) for b in range(len(final))]
            assert sorted(got) == members
            assert sum(map(price, final)) == pytest.approx(cost)
            for b, held in enumerate(got):
                assert [o for o, k in zip(offsets, bins, strict=True) if k == b] == [sum(held[:i]) for i in range(len(held))]
        assert sum(map(price, packing.pack(sizes, lengths, price)[2])) == pytest.approx(min(c for c, _, _ in plans.values()))
    assert opened == set(lengths)


def test_packing_against_all_ways():
    rnd, lengths = random.Random(20), (16, 32, 64)
    price = lambda x: 4 + x + x * x / 128
    ratios = []
    for _ in range(60):
        sizes = sorted((rnd.randint(1, 40) for _ in range(7)), reverse=True)
        ratios.append(sum(map(price, packing.pack(sizes, lengths, price)[2])) / cheapest(sizes, lengths, price))
    assert min(ratios) == pytest.approx(1.0) and sum(ratios) / len(ratios) < 1.08 and max(ratios) < 1.35


def test_default_lengths_compete():
    rnd = random.Random(21)
    sizes = sorted((min(4096, int(rnd.lognormvariate(5.5, 1.2)) + 1) for _ in range(3000)), reverse=True)
    bins, _, final = packing.pack(sizes)
    lengths = Counter(final)
    assert len([x for x, n in lengths.items() if n > 20]) >= 3
    assert sum(map(packing.cost, final)) <= min(sum(map(packing.cost, packing.plan(sizes, packing.LENGTHS, packing.cost, x)[2])) for x in packing.LENGTHS)
    assert sum(sizes) / sum(final) > 0.95


def test_packing_of_hot_ids_and_clashing_names(spark):
    rows = [(None, 3)] * 400 + [(7, 5)] * 400 + [(8, None), (9, -2), (10, 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, bin long").withColumn("piece", F.lit("x")).withColumn("row", F.lit("y"))
    out = packing.pack_documents(docs, F.col("bin"), group_pieces=100).collect()
    assert Counter(r.doc_id for r in out if r.doc_id in (None, 7)) == {None: 400, 7: 400}
    assert sorted((r.doc_id, r.first, r.n_tokens) for r in out if r.doc_id in (8, 9, 10)) == [(8, 0, 0), (9, 0, 0), *((10, 4096 * k, min(4096, 20_000 - 4096 * k)) for k in range(5))]
    by_part = Counter(r.bin >> 32 for r in out if r.doc_id is None)
    assert len(by_part) >= 8 and max(by_part.values()) < 100


# 3


def test_hosts_paths_and_rules(spark):
    urls = ["https://A.Example.com/en/77?q", "http://x.net/de/8#t", "HTTP://example.net/de/8", "nothing", None, "https://org", "https://b.org/es/1", "a://b://c/d", "https://h?x/y", "https://examplex.com/en/7"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "id long, bad int")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_tree.judge_urls(pages, none).collect()}
    assert out[0] == ("a.example.com", "/en/77", "example.com/en/7", "allow")
    assert out[1] == ("x.net", "/de/8", "net/de/", "allow")
    assert out[2] == ("example.net", "/de/8", "example.net/de/8", "block")
    assert out[3] == out[4] == ("", "", None, "allow")
    assert out[5] == ("org", "", None, "allow")
    assert out[6][2:] == ("org/es/", "block")
    assert out[7] == ("b:", "//c/d", None, "allow")
    assert out[8] == ("h", "", None, "allow")
    assert out[9][2:] == ("com/en/", "block")
    assert url_tree.judge_urls(pages.limit(0), none).count() == 0


def test_urls_of_a_million_characters(spark):
    urls = [f"https://h/{(c + 'a') * 500_000}" for c in "-/."] + ["https://h/a-b-c-d", "https://h/a-b-c", "https://h/a--b-c", f"https://{'-a.b' * 250_000}", "x" * 1_000_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "id long, bad int")
    out = {r.page_id: r for r in url_tree.judge_urls(pages, none).collect()}
    assert len(out[0].path) == len(out[1].path) == 1_000_001 and len(out[6].host) == 1_000_000
    shapes = {r.page_id: r.s for r in pages.select("page_id", url_tree.path_shape(url_tree.host_path(F.col("url"))[1]).alias("s")).where("page_id <> 1").collect()}
    assert [shapes[k] for k in (0, 2, 3, 4, 5)] == [["{s}"], ["{s}"], ["{s}"], ["a-b-c"], ["a--b-c"]]


def test_tree_rejects_impure_templates(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 2
        rows.append((i, f"https://h.test/{'spam' if bad else 'news'}/{i}"))
        if i % 4 < 2:
            labels.append((i, bad))
    for i in range(400, 600):  # as many children as pages: one wildcard
        rows.append((i, f"https://w.test/tag/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uv'[i // 100 % 2]}x"))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    out = {r.page_id: r for r in url_tree.judge_urls(pages, spark.createDataFrame(labels, "id long, bad int")).collect()}
    assert {out[i].verdict for i in range(1, 400, 2)} == {"block"} and {out[i].template for i in range(1, 400, 2)} == {"/spam/{n}"}
    assert {out[i].verdict for i in range(0, 400, 2)} == {"allow"}
    assert {out[i].template for i in range(400, 600)} == {"/tag/*"}


def test_a_bad_section_among_many(spark):
    rows = [(i, f"https://m.test/{'spam' if i % 60 == 0 else f'part{i % 60}x'}/{i}") for i in range(6000)]
    labels = [(i, int(i % 60 == 0)) for i, _ in rows if i % 120 < 60]
    out = url_tree.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "id long, bad int")).collect()
    assert {(r.page_id % 60 == 0, r.template, r.verdict) for r in out} == {(True, "/spam/{n}", "block"), (False, "/*/{n}", "allow")}


def tree_by_force(paths):
    """Templates of the paths of one host, from {shape: (pages, labels, bad)}, by recursion over lists."""
    out = {}

    def build(above, rows):
        rests = [rest for rest, _ in rows]
        if len(set(rests)) == 1:
            out.update({shape: above + rests[0] for _, shape in rows})
            return
        shared = 0
        while len({rest[: shared + 1] for rest in rests}) == 1 and len(rests[0]) > shared:
            shared += 1
        above += rests[0][:shared]
        children = {}
        for rest, shape in rows:
            if len(rest) == shared:
                out[shape] = above
            else:
                children.setdefault(rest[shared], []).append((rest[shared + 1 :], shape))
        sums = {c: [sum(paths[shape][k] for _, shape in members) for k in range(3)] for c, members in children.items()}
        group = dict.fromkeys(children, "")
        while True:
            moves = {}
            for c in children:
                n, bad = sums[c][1:]
                m, other = (sum(sums[d][k] for d in children if d != c and group[d] == group[c]) for k in (1, 2))
                if n >= 10 and m >= 10:
                    rate = (bad + other) / (n + m)
                    error = math.sqrt(rate * (1 - rate) * (1 / n + 1 / m))
                    if abs(bad / n - other / m) > url_tree.Z * error:
                        moves[c] = "+" if bad / n > other / m else "-"
            if not moves:
                break
            for c, way in moves.items():
                group[c] += way
        varies = sum(s[0] for s in sums.values()) < url_tree.VARIES * len(children)
        named = {}
        for c, members in children.items():
            similar = sum(sums[d][1] >= 10 and group[d] == group[c] for d in children)
            merged = (similar > 1 or (varies and not group[c])) if sums[c][1] >= 10 else varies
            named.setdefault("*" + group[c] if merged else c, []).extend(members)
        for name, members in named.items():
            build((*above, name), members)

    build((), [(shape, shape) for shape in paths])
    return out


def test_tree_equals_brute_force(spark):
    rnd = random.Random(33)
    rates = {f"s{k}": rnd.choice([0.0, 0.1, 0.5, 0.9, 0.95]) for k in range(9)}
    rows, labels = [], []
    for i in range(4000):
        host = rnd.choice(["a.test", "b.test"])
        section = rnd.choice(list(rates))
        deep = "/x/y/z" * rnd.choice([0, 0, 1, 6])
        tail = rnd.choice(["", "/", f"/w{rnd.randint(0, 900)}", f"/{rnd.choice('abc')}/q"])
        rows.append((i, f"https://{host}/{rnd.choice(['u', 'v'])}/{section}{deep}{tail}"))
        if rnd.random() < 0.6:
            labels.append((i, int(rnd.random() < rates[section])))
    rows += [(5000, "https://a.test/" + "/".join(f"d{k}" for k in range(3000))), (5001, "https://b.test/" + "k" * 100_000), (5002, None), (5003, "https://c.test"), (None, rows[0][1]), (0, rows[0][1])]
    labels += [(0, 0), (0, 1), (None, 1)]
    of = {}
    for i, bad in labels:
        of.setdefault(i, []).append(bad)
    paths = {}
    for i, url in rows:
        host, path = ("", "") if url is None else re.match(r"https://([^/]*)(.*)", url).groups()
        shape = tuple("{s}" if len(s) > 40 else s for s in path.split("/")[1:])
        found = paths.setdefault(host, {}).setdefault(shape, [0, 0, 0.0])
        found[0] += 1
        if i in of and i is not None:
            found[1] += 1
            found[2] += sum(of[i]) / len(of[i])
    want = {host: tree_by_force(shapes) for host, shapes in paths.items()}
    share = sum(p[2] for shapes in paths.values() for p in shapes.values()) / sum(p[1] for shapes in paths.values() for p in shapes.values())
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("x")).withColumn("above", F.lit("y"))
    out = url_tree.judge_urls(pages, spark.createDataFrame(labels, "id long, bad int")).collect()
    assert len(out) == len(rows)
    assert len({t for shapes in want.values() for t in shapes.values()}) > 20 and any("*+" in t for t in want["a.test"].values())
    for r in out:
        shape = tuple("{s}" if len(s) > 40 else s for s in r.path.split("/")[1:])
        template = want[r.host][shape]
        assert r.template == "/" + "/".join(template), (r.host, shape)
        n, bad = (sum(p[k] for s, p in paths[r.host].items() if want[r.host][s] == template) for k in (1, 2))
        assert r.bad_share == pytest.approx((bad + url_tree.PRIOR * share) / (n + url_tree.PRIOR))
        assert r.verdict == ("block" if r.bad_share >= url_tree.REJECT and n else "allow")


# 4


def dedup_by_force(docs, least=50):
    """Lines of every run of lines with so many words that came before, in (id, line) order."""
    split = {i: t.split("\n") for i, t in docs}
    rows = {i: [(k, s, len(WORDS.findall(s))) for k, s in enumerate(lines) if WORDS.search(s)] for i, lines in split.items()}
    seen, gone = {}, set()
    for i in sorted(rows):
        lines = rows[i]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(x[2] for x in lines[a : b + 1]) < least:
                    continue
                key = tuple(x[1] for x in lines[a : b + 1])
                if key in seen:
                    gone |= {(i, x[0]) for x in lines[a : b + 1]}
                else:
                    seen[key] = (i, a)
    for i, lines in rows.items():  # lines without words between two that go
        for (x, *_), (y, *_) in itertools.pairwise(lines):
            if {(i, x), (i, y)} <= gone:
                gone |= {(i, k) for k in range(x, y)}
    return {i: "\n".join(s for k, s in enumerate(lines) if (i, k) not in gone) for i, lines in split.items()}


def test_line_dedup_equals_brute_force(documents):
    rnd = random.Random(3)
    pool = [sentence(rnd, n) for n in (1, 3, 8, 20, 30, 49, 50, 60)] + ["", " \t"]
    docs = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 14)))) for i in range(60)]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(docs)).collect()}
    assert out == dedup_by_force(docs)


def test_fingerprints_are_few_and_guaranteed(documents):
    rnd = random.Random(30)
    passage = [sentence(rnd, rnd.randint(3, 9)) for _ in range(30)]
    docs = documents([(i, "\n".join([*(sentence(rnd, 5) for _ in range(20 + i)), *passage, *(sentence(rnd, 7) for _ in range(20))])) for i in range(6)])
    lines = line_dedup.winnowed(line_dedup.lines_of(docs, "doc_id", "text"), 50).collect()
    picks = [r.pick for r in lines if r.pick]
    assert len(picks) < len(lines) / 3
    by_doc = {i: {r.pick.h for r in lines if r.pick and r.doc == i} for i in range(6)}
    assert len(set.intersection(*by_doc.values())) >= 3
    near = line_dedup.near_repeats(line_dedup.winnowed(line_dedup.lines_of(docs, "doc_id", "text"), 50), 50).count()
    assert 6 * 30 <= near < len(lines)


def test_clashing_names_and_repeated_rows(spark):
    rnd = random.Random(31)
    x = sentence(rnd, 70)
    rows = [(1, x, 5, "a"), (2, "b\n" + x, 6, "b"), (2, "b\n" + x, 6, "b"), (None, "", 7, "c"), (3, None, 8, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash int, ranges string")
    for name in ("lines", "line", "row", "left", "n_deleted", "pick"):
        docs = docs.withColumn(name, F.lit(name))
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "", r.hash, r.ranges, r.left) for r in out.collect()) == [(0, "", 7, "c", "left"), (1, x, 5, "a", "left"), (2, "b", 6, "b", "left"), (2, "b", 6, "b", "left"), (3, "", 8, "d", "left")]


def test_tail_that_only_another_copy_has(documents):
    rnd = random.Random(9)
    x, y = sentence(rnd, 60), sentence(rnd, 5)
    docs = [(1, x), (2, x + "\n" + y), (3, x + "\n" + y)]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(docs)).collect()}
    assert out == {1: x, 2: y, 3: ""}


def test_line_dedup_of_odd_rows(odd):
    out = line_dedup.dedup_lines(odd, count_col="lost")
    assert out.columns == [*odd.columns, "lost"] and out.count() == odd.count()
    found = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert found[1].text is None and found[2].text == "" and found[5].text == "" and found[5].lost == 1 and found[4].lost == 0
    assert found[6].text == " \n\t "
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


# 5


def print_of(text):
    w = WORDS.findall((text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def grouped(prints):
    """Index to smallest index reachable."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(prints))]


def test_simhash_equals_brute_force(documents):
    rnd = random.Random(4)
    docs = []
    for _ in range(40):
        words = sentence(rnd, 150).split()
        for _ in range(rnd.randint(1, 4)):
            copy = words[:]
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(len(copy))] = "New"
            docs.append((len(docs), " ".join(copy)))
    docs += [(len(docs), ""), (len(docs) + 1, None), (len(docs) + 2, "One two")]
    out = {r.doc_id: r for r in simhash.near_duplicates(documents(docs)).collect()}
    prints = [print_of(t) for _, t in docs]
    assert [out[i].print % (1 << 64) for i, _ in docs] == prints
    assert [out[i].component_id for i, _ in docs] == grouped(prints)


def test_count_filter_keeps_all_links_and_few_others():
    import numpy as np

    rnd = random.Random(41)
    base = rnd.getrandbits(64)
    near = [base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for _ in range(60)]
    far = [(base & 0xFFFFFFFF) << 0 | rnd.getrandbits(32) << 32 for _ in range(300)]  # all share four bytes, as in one list
    values = np.array(near + far, np.uint64)
    for distance in range(4):
        x, y = simhash.candidates(values, values, distance)
        kept = set(zip(x.tolist(), y.tolist(), strict=True))
        shared = lambda a, b: sum(p == q for p, q in zip(a.to_bytes(8), b.to_bytes(8), strict=True))
        numbers = values.tolist()
        assert kept == {(i, j) for i, a in enumerate(numbers) for j, b in enumerate(numbers) if shared(a, b) >= 8 - distance}
        assert {(i, j) for i, a in enumerate(numbers) for j, b in enumerate(numbers) if (a ^ b).bit_count() <= distance} <= kept
    assert len(kept) < len(values) ** 2 / 20


def test_links_of_a_large_list_in_blocks(spark):
    rnd = random.Random(6)
    base = rnd.getrandbits(64)
    prints = sorted({base ^ sum(1 << b for b in rnd.sample(range(24), rnd.randint(0, 5))) for _ in range(400)})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in prints]
    edges = simhash.links(spark.createDataFrame(signed, "print long"), block=50)
    found = {r.node: r.component for r in simhash.components(edges).collect()}
    want = grouped(prints)
    classes = lambda f: sorted(sorted(i for i in range(len(prints)) if f(i) == c) for c in {f(i) for i in range(len(prints))})
    assert classes(lambda i: found.get(signed[i][0], signed[i][0])) == classes(lambda i: want[i])


def test_simhash_of_odd_rows(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 10
    assert {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert {r.component_id for r in rows if r.print == 0} == {1}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 4), (False, 7)]
    nulls = odd.where("doc_id is null")
    assert simhash.keep_one(nulls.union(nulls)).count() == 2
    named = odd.withColumn("hash", F.lit(1)).withColumn("key", F.lit(2)).withColumn("row", F.lit(3)).withColumn("_near_doc", F.lit(4)).withColumn("component", F.lit(5))
    again = simhash.keep_one(named)
    assert again.columns == named.columns and again.count() == 4 and simhash.near_duplicates(named).count() == 10


def test_distances_beyond_the_index_are_refused():
    with pytest.raises(ValueError, match="distances up to 3"):
        simhash.links(None, 4)


def test_one_row_stays_where_ids_repeat(documents):
    words = sentence(random.Random(14), 300).split()
    near = [" ".join(words), " ".join(["New", *words[1:]]), " ".join([*words[:-1], "Other"])]
    prints = [print_of(t) for t in near]
    assert grouped(prints) == [0, 0, 0]
    for i in (5, None):
        docs = documents([(i, t) for t in [*near, near[0]]])
        assert simhash.keep_one(docs).count() == 1


# 6


def test_lattice_sums_over_all_segmentations():
    import numpy as np

    pieces = ("", "▁", "▁a", "a", "b", "ab", "▁ab", chr(0xDC00 + 0xC3), chr(0xDC00 + 0xA9))
    logs = np.log(np.array([1e-9, 0.1, 0.1, 0.2, 0.1, 0.15, 0.05, 0.1, 0.2]))
    lattice = lattice_lm.Lattice(lattice_lm.Trie(pieces), logs)

    def force(s):
        """Sum over the segmentations, and expected uses of each piece times that sum."""
        if not s:
            return 1.0, np.zeros(len(pieces))
        p, uses = 0.0, np.zeros(len(pieces))
        steps = [(math.exp(logs[i]), len(q), [i]) for i, q in enumerate(pieces) if q and s.startswith(q)]
        if s[0] == "é":
            steps = [(math.exp(logs[7] + logs[8]), 1, [7, 8])]
        for w, n, ids in steps:
            q, rest = force(s[n:])
            p += w * q
            uses += w * rest
            uses[ids] += w * q
        return p, uses

    words = ["", "a", "ab", "abab", "aabb", "é", "abéab"]
    counts, total = np.array([1.0, 2, 3, 4, 5, 6, 7]), np.zeros(len(pieces))
    found = lattice.scores(words, counts, total)
    want = [force("▁" + w) for w in words]
    assert found == pytest.approx([math.log(p) for p, _ in want])
    assert total == pytest.approx(sum(c * uses / p for c, (p, uses) in zip(counts, want, strict=True)))
    assert lattice.scores(["ab" * 40, "a"]) == pytest.approx([lattice.scores(["ab" * 40])[0], lattice.scores(["a"])[0]])


def test_expected_counts_of_rare_and_long_words():
    import numpy as np

    pieces, scores = lattice_lm.vocabulary(PIECES)
    lattice = lattice_lm.Lattice(lattice_lm.trie(PIECES), lattice_lm.first_logs(pieces, scores))
    length = [1 if p and "\udc00" <= p <= "\udcff" else len(p.encode("utf-8", "replace")) for p in pieces]
    for word in ("\U0001f3c6" * 13, "\U0001fae0" * 12, "".join(chr(0x1D400 + k) for k in range(13)), "\u1230\u120b\u121d" * 6 + "\u1230", "ab" * 20_000):
        total = np.zeros(len(pieces))
        lattice.scores([word], np.array([2.0]), total)
        assert np.isfinite(total).all()
        assert total @ length == pytest.approx(2 * len(("\u2581" + word).encode()), rel=1e-6)


def test_language_model(documents):
    """All columns from a model made in plain Python, sums over segmentations included."""
    import numpy as np

    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choice("The of and running runner run walked walking").lower() + rnd.choice(["", "ed", "ing"]) for _ in range(rnd.randint(0, 40)))) for i in range(120)] + [(500, None), (501, "Étrange\tmots\n"), (502, "x" * 100), (None, "the end"), (None, None), (503, "run"), (503, "run"), (504, "rund " * 3000)]
    df = documents(docs)
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    rows = lattice_lm.score_documents(df.withColumn("word", F.lit(1)).withColumn("score", F.lit("x")), PIECES, held, head=8).collect()
    assert len(rows) == len(docs)
    key = lambda i, n: (-1 if i is None else i, n)
    out = {key(r.doc_id, r.n_tokens): r for r in rows}
    low = [(i, WORDS.findall((t or "").translate(LOWER)), i is None or zlib.crc32(str(i).encode()) % 10 != 0) for i, t in docs]
    c = Counter(w for _, ws, train in low if train for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    pieces, scores = lattice_lm.vocabulary(PIECES)
    logs, at = lattice_lm.first_logs(pieces, scores), {p: i for i, p in enumerate(pieces) if p}

    def force(s, logs):
        """Probability, and expected uses, by forward and backward sums over plain products."""
        arcs = [(i, j, [at[s[i:j]]]) for i in range(len(s)) for j in range(i + 1, len(s) + 1) if s[i:j] in at]
        arcs += [(i, i + 1, [at[chr(0xDC00 + b)] for b in s[i].encode()]) for i in range(len(s)) if s[i] not in at]
        f, g = [1.0] + [0.0] * len(s), [0.0] * len(s) + [1.0]
        for i, j, ids in sorted(arcs):
            f[j] += f[i] * math.exp(sum(logs[ids]))
        for i, j, ids in sorted(arcs, reverse=True):
            g[i] += g[j] * math.exp(sum(logs[ids]))
        uses = Counter()
        for i, j, ids in arcs:
            for k in ids:
                uses[k] += f[i] * g[j] * math.exp(sum(logs[ids])) / f[-1]
        return f[-1], uses

    distinct = {w for _, ws, _ in low for w in ws}
    pure = {w: force("▁" + w, logs) for w in distinct}
    uses = np.zeros(len(pieces))
    for w in distinct:
        for k, u in pure[w][1].items():
            uses[k] += c[w] * u
    smooth = (uses + lattice_lm.PIECE_ALPHA) * [bool(p) for p in pieces]
    whole = smooth.sum() + c[None] + lattice_lm.PIECE_ALPHA
    with np.errstate(divide="ignore"):
        learnt = np.log(smooth / whole)
    model = {w: force("▁" + w, learnt)[0] for w in distinct} | {None: (c[None] + lattice_lm.PIECE_ALPHA) / whole}
    for i, ws, train in low:
        words = [*ws, None]
        r = out[key(i, len(words))]
        assert r.held_out is not train and r.train_tokens == n
        assert r.n_known == sum(c[w] > 0 for w in words)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
        assert r.marginal == pytest.approx(sum(math.log10(pure[w][0]) for w in ws))
        assert r.score == pytest.approx(sum(math.log10((c[w] + v * model[w]) / (n + v)) for w in words))
    assert sum(r.score for r in rows if r.held_out) > sum(r.marginal for r in rows if r.held_out)
    none = lattice_lm.score_documents(df.limit(0), PIECES, held)
    assert none.count() == 0 and none.columns == list(rows[0].asDict())


# 8


def phrases_by_force(text):
    """Phrases of the left-to-right parse: each the shortest beginning of the rest that is no phrase yet."""
    found, at = [], 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in found:
            end += 1
        if end > len(text):
            break
        found.append(text[at:end])
        at = end
    return set(found)


def smallest_by_force(text):
    return sorted({xxhash.xxh32_intdigest(p) for p in phrases_by_force(text)})[: lz_fingerprint.SIZE]


def like_by_force(a, b):
    if not a or not b:
        return float(a == b)
    both = sorted({*a, *b})[: lz_fingerprint.SIZE]
    return sum(x in a and x in b for x in both) / len(both)


def test_chain_equals_brute_force(documents):
    import hashlib

    rnd = random.Random(8)
    docs = [(i * 3, sentence(rnd, rnd.randint(0, 60)) if i % 7 else "") for i in range(50)] + [(1000, "x"), (1001, "x"), (1002, None), (1003, "ab" * 2000), (1004, "ab" * 1999 + "é🙂")]
    table = documents(docs).withColumn("hash", F.lit("x")).withColumn("part", F.lit("y")).withColumn("key", F.lit("z"))
    out = {r.doc_id: r for r in lz_fingerprint.chain(table).collect()}
    order = sorted(((i, t or "") for i, t in docs), reverse=True)
    prints = [smallest_by_force(t) for _, t in order]
    assert len(out) == len(docs)
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + after[:m]
        changed = smallest_by_force(edited)
        r = out[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{h:08x}" for h in prints[k])
        assert r.edited_fingerprint == "".join(f"{h:08x}" for h in changed)
        assert r.near_edited == like_by_force(prints[k], changed)
        assert r.near_next == like_by_force(prints[k], prints[(k + 1) % len(order)])


def test_likeness_estimates_that_of_all_phrases():
    rnd = random.Random(81)
    off = []
    for share in (0.0, 0.3, 0.6, 0.9):
        a = sentence(rnd, 800)
        b = a[: int(len(a) * share)] + sentence(rnd, 800)[: int(len(a) * (1 - share))]
        p, q = phrases_by_force(a), phrases_by_force(b)
        off.append(lz_fingerprint.likeness(lz_fingerprint.fingerprint(a), lz_fingerprint.fingerprint(b)) - len(p & q) / len(p | q))
    assert max(map(abs, off)) < 0.2 and abs(sum(off) / len(off)) < 0.1


def test_chain_of_one_id_is_dealt_to_many_ranges(documents):
    rnd = random.Random(82)
    docs = [(5, sentence(rnd, 9)) for _ in range(60)] + [(None, sentence(rnd, 9)) for _ in range(30)] + [(k, sentence(rnd, 9)) for k in (3, 4, 8)]
    rows = lz_fingerprint.chain(documents(docs)).collect()
    hash_of = {t: xxhash.xxh64_intdigest(t.encode(), 42) for _, t in docs}
    signed = lambda t: hash_of[t] - (1 << 64) if hash_of[t] >> 63 else hash_of[t]
    order = sorted(docs, key=lambda d: (-(d[0] if d[0] is not None else -(1 << 63)), signed(d[1])))
    want = Counter()
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        want[(i, "".join(f"{h:08x}" for h in smallest_by_force(t)), like_by_force(smallest_by_force(t), smallest_by_force(after)))] += 1
    assert Counter((r.doc_id, r.fingerprint, r.near_next) for r in rows) == want


def test_chain_of_odd_rows(odd):
    rows = lz_fingerprint.chain(odd).collect()
    assert len(rows) == 10
    same = {r.fingerprint for r in rows if r.doc_id in (4, 5)}
    assert len(same) == 1
    assert lz_fingerprint.chain(odd.limit(0)).count() == 0
    assert lz_fingerprint.chain(odd.where("doc_id = 7")).first().near_next == 1.0


# 9


def base_by_force(text):
    t = text or ""
    w = WORDS.findall(t)
    lines = [s for s in t.split("\n") if WORDS.search(s)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(grams)
    again = {j for i, g in enumerate(grams) if c[g] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def test_base_rules_equal_brute_force(documents, odd):
    rnd = random.Random(10)
    docs = [(i, "\n".join(rnd.choice(["a b c", "a b", "x # y|z", "", " ", "ä ö ü a b c"]) for _ in range(rnd.randint(0, 30)))) for i in range(80)]
    for df in (documents(docs), odd):
        rows = line_rules.judge(df.withColumn("words", F.lit(1))).collect()
        assert len(rows) == df.count()
        for r in rows:
            q = r.rules
            assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == base_by_force(r.text)
            assert not (q.base_failed and q.kept)
    assert line_rules.judge(odd.limit(0)).count() == 0


def test_line_rules(documents):
    rnd = random.Random(11)
    clean = "\n".join(sentence(rnd, 20) for _ in range(6))
    junk = "\n".join(sentence(rnd, 20).replace(" ", "### ") for _ in range(6))
    nav = " | ".join(sentence(rnd, 60).split())
    shout = "\n".join(sentence(rnd, 20).upper().replace(" ", "!! ") for _ in range(6))
    docs = documents([(1, clean), (2, junk), (3, nav), (4, shout), (5, clean + "\nHome\nAccept all cookies now."), (6, clean + "\n" + junk + "\n" + junk.replace("a", "b"))])
    out = {r.doc_id: r.rules for r in line_rules.judge(docs).collect()}
    assert [out[i].kept for i in range(1, 7)] == [True, False, False, False, True, False]
    assert out[1].text == clean and out[5].text == clean
    # A filter on the verdict doesn't repeat the work for each element.
    assert line_rules.judge(docs).where("rules.kept").count() == 2


# The pipeline


def test_pipeline_equals_brute_force(spark, documents, tmp_path):
    import corpus_pipeline

    rnd = random.Random(12)
    passage = sentence(rnd, 70)
    docs = []
    for i in range(40):
        t = "\n".join(sentence(rnd, 30) for _ in range(5))
        docs.append((2 * i, t))
    docs += [(101, docs[3][1]), (103, docs[4][1].replace("\n", " ")), (105, docs[4][1].replace("\n", " ")[:-9]), (107, docs[5][1] + "\n" + passage), (109, passage + "\n" + sentence(rnd, 60)), (111, "too short"), (113, " ".join(["x"] * 200))]
    documents(docs).write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [(i, t) for i, t in docs if not base_by_force(t)[5]]
    assert len(kept) == len(docs) - 2
    left = sorted((i, t) for i, t in dedup_by_force(kept).items() if WORDS.search(t))
    roots = grouped([print_of(t) for _, t in left])
    want = {i: len(WORDS.findall(t)) + 1 for k, (i, t) in enumerate(left) if roots[k] == k}
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.n_tokens
    assert got == Counter(want) and 101 not in got and 109 in got
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "best_fit_packing"]


def test_pipeline_of_odd_rows(spark, documents, tmp_path):
    import corpus_pipeline

    rnd = random.Random(121)
    long = "\n".join(sentence(rnd, 30) for _ in range(700))
    text = "\n".join(sentence(rnd, 30) for _ in range(5))
    docs = [(1, None), (2, ""), (3, text), (3, text), (None, text), (4, long), (5, long + "\n" + sentence(rnd, 60)), (None, None), (6, " \n\t ")]
    table = documents(docs)
    for name in ("rules", "n_deleted", "_near_doc", "_rules_text", "lines", "hash", "row"):
        table = table.withColumn(name, F.lit(name))
    table.write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.n_tokens
    # Null ids come first, so the text of 3 is a copy; the new end of 5 stays.
    assert got == {None: 151, 4: 21_001, 5: 61}
    docs = table.where("doc_id is not null")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == table.columns, name
    table.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_near_dedup_equals_jaccard_brute_force(spark, documents):
    import corpus_pipeline

    rnd = random.Random(13)
    docs = []
    for _ in range(40):
        words = sentence(rnd, rnd.choice([6, 40, 150, 400])).split()
        for _ in range(rnd.randint(1, 5)):
            copy = words[:]
            for _ in range(rnd.randint(0, max(1, len(copy) // 40))):
                copy[rnd.randrange(len(copy))] = "New"
            docs.append((len(docs), " ".join(copy)))
    docs += [(len(docs) + k, t) for k, t in enumerate(["", "One two", "one  TWO", " "])]

    def set_of(t):
        w = WORDS.findall((t or "").translate(LOWER))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets, root = [set_of(t) for _, t in docs], list(range(len(docs)))
    for x, y in itertools.combinations(range(len(docs)), 2):
        if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
            p, q = sorted((root[x], root[y]))
            root = [p if r == q else r for r in root]
    assert {i for i, r in enumerate(root) if i == r} != {i for i, r in enumerate(grouped([print_of(t) for _, t in docs])) if i == r}
    out = corpus_pipeline.near_dedup(spark, documents(docs), "")
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(root))
    table = documents(docs)
    rows = shingle_join.sets_of(table, "doc_id", "text").cache()
    sets_table = rows.drop("doc_id").dropDuplicates(["print"])
    found = simhash.grouped(rows.select("doc_id", "hash", "print"), lambda _: shingle_join.links(table, sets_table, block=2, text_block=2))
    assert {r.doc_id: r.component_id for r in found.collect()} == dict(enumerate(root))


def test_near_dedup_links_by_fingerprints_and_verifies_them(spark, documents):
    rnd = random.Random(14)
    base = sentence(rnd, 600).split()
    changed = [base[:k] + ["New"] + base[k + 1 :] for k in (100, 300, 500)]
    docs = documents([(k, " ".join(w)) for k, w in enumerate([base, *changed, sentence(rnd, 600).split(), sentence(rnd, 600).split()])])
    rows = shingle_join.sets_of(docs, "doc_id", "text").collect()
    bits, prints = {r.doc_id: r.bits for r in rows}, {r.print: r.doc_id for r in rows}
    for k, r in enumerate(rows):
        assert r.bits & (1 << 64) - 1 == simhash.majority(shingle_join.shingles(shingle_join.words_of(docs.where(f"doc_id = {r.doc_id}").first().text))), k
    near = [(x, y) for x, y in itertools.combinations(range(4), 2) if ((bits[x] ^ bits[y]) & (1 << 64) - 1).bit_count() <= 3]
    assert near
    # Without entries in the index by shingles only fingerprints link; equal fingerprints of unlike texts don't.
    blind = spark.createDataFrame([(r.print, r.hash, r.n, [], r.odd, bits[4] if r.doc_id == 5 else r.bits) for r in rows], "print long, hash long, n int, first array<long>, odd binary, bits long")
    found = [tuple(sorted((prints[r.a], prints[r.b]))) for r in shingle_join.links(docs, blind).collect()]
    assert (4, 5) in {tuple(sorted((prints[r.a], prints[r.b]))) for r in shingle_join.near_prints(blind).collect()}
    assert found and set(found) <= set(near)
    assert len(set(grouped_by(found, 4))) == len(set(grouped_by(near, 4)))


def grouped_by(pairs, n):
    root = list(range(n))
    for x, y in pairs:
        p, q = sorted((root[x], root[y]))
        root = [p if r == q else r for r in root]
    return root


def test_blocks_meet_once_and_large_components_move_once(spark):
    from pyspark.sql import functions as F

    rows = [(1, k, 7 if k < 900 else k) for k in range(910)] + [(2, k, k % 3) for k in range(60)] + [(3, k, 0) for k in range(50)] + [(4, k, k // 9) for k in range(15)]
    table = spark.createDataFrame(rows, "key long, print long, component long")
    sizes = shingle_join.largest(table, "key")
    assert {(r.key, r.members, r.others) for r in sizes.collect()} == {(1, 900, 10), (2, 20, 40), (4, 9, 6)}
    # Key 4 has one block, so all its rows are there once.
    members = F.when(F.col("key") == 4, 0).otherwise(F.ceil(F.col("members") / 16))
    dealt = shingle_join.deal(table.join(sizes, "key"), "key", F.ceil(F.col("others") / 16), members, "component")
    blocks, copies = {}, {}
    for r in dealt.collect():
        blocks.setdefault((r.key, r.i, r.j), []).append(r)
        copies.setdefault((r.key, r.component), []).append(r)
    assert len(copies[1, 7]) == 900 and len(copies[4, 0]) + len(copies[4, 1]) == 15
    met = []
    for (key, i, j), of in blocks.items():
        left = [r for r in of if not r.right]
        other = left if i == j else [r for r in of if r.right]
        met += [(key, *p) for p in {tuple(sorted((a.print, b.print))) for a in left for b in other if a.component != b.component}]
    component = {(key, k): c for key, k, c in rows}
    want = {(key, a, b) for key in (1, 2, 4) for a, b in itertools.combinations(sorted(k for x, k, _ in rows if x == key), 2) if component[key, a] != component[key, b]}
    assert len(met) == len(set(met)) and set(met) == want
