"""Operators over documents against brute force, with odd rows and empty tables."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievegrid.llm import components, decontaminate, jaccard, kernel, line_templates, packing, quality, rans, regions, repetition, substrings, tokens

from .fixtures import LOW, corpus, empty, frame, words

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
BYTES, WORDS = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/word_bpe_49k.json"


@pytest.fixture(scope="module")
def docs():
    return corpus()


@pytest.fixture(scope="module")
def df(spark, docs):
    return frame(spark, docs).repartition(5)


def test_words_and_hashes():
    texts = ["a  b\tc", "", None, " x", "\x0b\x0cé y z\r\n", "same same", "same"]
    data, offsets = kernel.text_bytes(pa.array(texts))
    h, starts, ends, rows = kernel.hash_words(data, offsets)
    for i, t in enumerate(texts):
        assert [bytes(data[a:b]) for a, b in zip(starts[rows[i] : rows[i + 1]], ends[rows[i] : rows[i + 1]])] == words(t)
    assert h[rows[5]] == h[rows[5] + 1] == h[rows[6]]
    assert list(kernel.inside(rows, 3)) == [i for i in range(len(h) - 2) if any(rows[k] <= i and i + 3 <= rows[k + 1] for k in range(len(texts)))]


def test_long_words_cross_hash_blocks():
    word = "x" * (kernel.LONG * 600 + 5)
    data, offsets = kernel.text_bytes(pa.array([f"{word} y {word}"]))
    h, *_ = kernel.hash_words(data, offsets)
    assert h[0] == h[2] != h[1]


def complements(n):
    """A Thue-Morse word and its complement: they meet under every polynomial hash modulo 2**64."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 512, 1024, 2048])
def test_no_structured_collisions(spark, n):
    a, b = complements(n)
    data, offsets = kernel.text_bytes(pa.array([a, b, a]))
    h, *_ = kernel.hash_words(data, offsets)
    assert h[0] == h[2] != h[1]
    encoder = tokens.Encoder(BYTES)
    ids, bounds = encoder.encode(data, offsets)
    for i, x in enumerate(library_ids(BYTES, [(0, a), (1, b), (2, a)])):
        assert [*ids[bounds[i] : bounds[i + 1]].tolist(), 2] == x.tolist()
    rest = " ".join(f"w{i}" for i in range(12))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(frame(spark, [(1, f"{a} w0 w1 w2 w3"), (2, f"{b} w0 w1 w2 w3")])).collect()}
    assert got == {1: 1, 2: 2}
    assert {r["n_removed"] for r in substrings.remove_repeats(frame(spark, [(1, f"{a} {rest}"), (2, f"{b} {rest}")])).collect()} == {0}
    assert {r["n_dup_lines"] for r in repetition.rules(frame(spark, [(1, f"{a}\n{b}")])).collect()} == {0}


def shingles(text):
    w = (text or "").encode().translate(LOW).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_components(docs):
    known = {i: shingles(t) for i, t in docs if i is not None}
    parent = {i: i for i in known}
    for a in known:
        for b in known:
            common = len(known[a] & known[b])
            if a < b and common and 100 * common >= 80 * (len(known[a]) + len(known[b]) - common):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {i: find(parent, i) for i in known}


def test_jaccard(spark, docs, df):
    want = brute_components(docs)
    got = jaccard.near_duplicates(df).collect()
    assert len(got) == len(docs)
    sizes = Counter((i, len(shingles(t))) for i, t in docs)
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == sizes
    for r in got:
        assert r["component_id"] == want.get(r["doc_id"])
    assert len({r["component_id"] for r in got if (r["doc_id"] or 0) in range(1000, 1012)}) == 1
    assert jaccard.near_duplicates(empty(spark)).collect() == []


def test_jaccard_levels_without_a_common_pivot(spark):
    """A chain of edits: far ends don't link, neighbours do; and texts that share half."""
    base = [f"w{i}" for i in range(100)]
    chain = []
    for k in range(12):
        base[k * 8 % 97] = f"edit{k}"
        chain.append((k, " ".join(base)))
    half = [(100 + k, " ".join([f"w{i}" for i in range(60)] + [f"own{k}x{i}" for i in range(40)])) for k in range(10)]
    docs = chain + half
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(frame(spark, docs)).collect()}
    assert got == brute_components(docs)


def random_cluster(r, n, members, edits):
    base = [f"b{i}" for i in range(n)]
    out = []
    for _ in range(members):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(n)] = f"e{r.randrange(60)}"
        out.append(" ".join(w))
    return out


def test_region_recursion():
    """Pivots, windows and blocks find the components of all pairs, in regions of any spread."""
    r = np.random.default_rng(5)
    for edits in (3, 9, 20):
        for leaf in (4, 64):
            sets = [np.unique(np.concatenate([np.setdiff1d(np.arange(100), r.integers(0, 100, r.integers(edits))), 100 + r.integers(0, 400, r.integers(edits))])).astype(np.uint64) for _ in range(150)]
            ids = np.arange(150)
            ids[7] = 3  # one document, two texts
            old, regions.LEAF = regions.LEAF, leaf
            try:
                work = regions.Region(np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets])), ids, 80)
                work.resolve(np.arange(150), 0)
            finally:
                regions.LEAF = old
            parent = {i: i for i in range(150)} | {7: 3}
            for a in range(150):
                for b in range(a):
                    common = len(np.intersect1d(sets[a], sets[b]))
                    if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                        x, y = find(parent, a), find(parent, b)
                        parent[max(x, y)] = min(x, y)
            root = work.links.roots(np.arange(150))
            want = [find(parent, i) for i in range(150)]
            assert len(set(zip(root.tolist(), want))) == len(set(root.tolist())) == len(set(want))


def test_large_regions_in_chunks(spark):
    """Regions dealt out in chunks, of few rows or of few bytes, lose no link."""
    import random

    r = random.Random(9)
    docs = list(enumerate(random_cluster(r, 60, 90, 3) + random_cluster(r, 60, 60, 7)))
    want = brute_components(docs)
    assert 1 < len(set(want.values())) < 150
    for limits in ({"chunk": 20}, {"chunk_bytes": 9000}):
        got = {x["doc_id"]: x["component_id"] for x in jaccard.near_duplicates(frame(spark, docs), **limits).collect()}
        assert got == want


def test_a_templates_pages_are_divided_by_new_pivots(spark, monkeypatch):
    """Pages that share a template but nothing else: work in proportion, and no link between them lost or made."""
    made, real = [], jaccard._with_sets
    monkeypatch.setattr(jaccard, "_with_sets", lambda docs, units: made.append(units.count()) or real(docs, units))
    chosen = jaccard.chosen_pivots
    monkeypatch.setattr(jaccard, "chosen_pivots", lambda found, sizes, percent: chosen(found, sizes, percent, chunk=64))
    template, copies = " ".join(f"t{i}" for i in range(60)), {}
    for n in (100, 400):
        own = lambda k: " ".join(f"o{k - (k % 10 == 3)}x{i}" for i in range(35))  # noqa: E731  every tenth page has a twin
        docs = [(k, f"{template} {own(k)}") for k in range(n)] + [(2000 + k, f"{template} {own(k)} edited{k}") for k in range(0, n, 25)]
        made.clear()
        got = {x["doc_id"]: x["component_id"] for x in jaccard.near_duplicates(frame(spark, docs), chunk=32).collect()}
        assert got == {k: k - (k % 10 == 3) for k in range(n)} | {2000 + k: k for k in range(0, n, 25)}
        copies[n] = sum(made)
    assert copies[400] < 4.6 * copies[100]


def test_regions_below_regions(spark):
    """Templates within templates, texts with one id, and near copies that only blocks can tell apart."""
    import random

    r = random.Random(21)
    site, parts = [f"t{i}" for i in range(50)], [[f"s{p}w{i}" for i in range(20)] for p in range(3)]
    docs = []
    for k in range(110):
        words = [*site, *parts[k % 3], *(f"o{k // 2}x{i}" for i in range(25))]
        for _ in range(r.randrange(0, 14)):
            words[r.randrange(len(words))] = f"e{r.randrange(500)}"
        docs.append((k, " ".join(words)))
    docs += [(k, t + " tail") for k, t in docs[:12]] + [(3, None), (400, docs[7][1])]
    base = [f"w{i}" for i in range(70)]
    docs += [(1000 + k, " ".join(random.Random(k // 2).sample(base, 66))) for k in range(40)]
    want = brute_components(docs)
    got = {x["doc_id"]: x["component_id"] for x in jaccard.near_duplicates(frame(spark, docs), chunk=16).collect()}
    assert got == want


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (95, 90), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {0: 0} | {100: 90, 95: 90, 90: 90} or got == {i: 0 for i in range(1, 41)} | {100: 90, 95: 90}


def repeated_words(docs, length=13):
    """For each (id, text), which of its words lie in a window that a smaller id holds too."""
    first = {}
    for i, t in docs:
        w = words(t)
        if i is not None:
            for k in range(len(w) - length + 1):
                first[tuple(w[k : k + length])] = min(first.get(tuple(w[k : k + length]), i), i)

    def gone(i, t):
        w, out = words(t), set()
        for k in range(len(w) - length + 1):
            if i is not None and first[tuple(w[k : k + length])] < i:
                out |= set(range(k, k + length))
        return w, out

    return gone


@pytest.mark.parametrize("hot", [substrings.HOT, 2])
def test_substrings(spark, docs, df, hot):
    """Also with every frequent anchor lengthened, and for an id that has two texts."""
    gone, base = repeated_words(docs), docs
    if hot == 2:
        base = docs + [(0, docs[3][1]), (1000, "a text of its own " * 9)]
        df, gone = frame(spark, base).repartition(5), repeated_words(base)

    def removed(i, t):
        w, out = gone(i, t)
        return len(w), len(out), b" ".join(x for k, x in enumerate(w) if k not in out).decode()

    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(df, hot=hot).collect())
    assert got == Counter((i, *removed(i, t)) for i, t in base)
    assert sum(r[2] > 0 for r in got) > 10
    assert substrings.remove_repeats(empty(spark)).collect() == []


def test_repeats_are_maximal(spark, docs, df):
    """The runs of words, none of which could start earlier or end later."""
    gone, want = repeated_words(docs), Counter()
    for i, t in docs:
        w, out = gone(i, t)
        for k in sorted(out):
            if k - 1 not in out:
                end = k
                while end in out:
                    end += 1
                want[(i, k, end - k)] += 1
    got = Counter(tuple(r) for r in substrings.repeats(df).collect())
    assert got == want and max(n for _, _, n in got) > 13


def test_line_templates(spark):
    own = lambda i: " ".join(f"{x}{chr(97 + i % 26)}{chr(97 + i // 26)}" for x in ("q", "w", "e", "r"))
    docs = [(i, f"opening {own(i)}\nLicensed by Firm{'ABC'[i % 3]} under the terms of version {i}\nbody {own(i + 40)}") for i in range(30)]
    # a text and its many near copies: the same neighbours, so not boilerplate
    docs += [(100 + i, "first line of it all\nsecond line of it all\nthird line of it all") for i in range(40)]
    docs += [(500, None), (501, ""), (502, "\n\n"), (None, docs[0][1]), docs[1], docs[1]]
    got = line_templates.drop_recurring(frame(spark, docs), counts=("n_lines", "n_dropped"), min_texts=10)
    assert got.columns[: len(frame(spark, docs).columns)] == frame(spark, docs).columns
    rows = [(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()]
    assert len(rows) == len(docs)
    for i, text, n_lines, n_dropped in rows:
        source = [t for j, t in docs if j == i][0]
        if source is None:
            assert (text, n_lines, n_dropped) == (None, 0, 0)
        elif "Licensed" in source:
            assert n_dropped == 1 and "Licensed" not in text and text == "\n".join(x for x in source.split("\n") if "Licensed" not in x)
        else:
            assert text == source and n_dropped == 0 and n_lines == len(source.split("\n"))
    assert line_templates.drop_recurring(empty(spark)).collect() == []


def dropped(spark, docs, **rules):
    """The lines that the pipeline's rule drops of each document."""
    got = line_templates.drop_recurring(frame(spark, docs), find=line_templates.boilerplate_lines, **rules)
    kept = {r["doc_id"]: r["text"].split("\n") for r in got.collect()}
    return {i: [x for x in t.split("\n") if x not in kept[i]] for i, t in docs}


def prose(*at):
    """A line of its own for each place."""
    return " ".join(hashlib.md5(f"{at} {i}".encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(6))


def test_boilerplate_beside_copies_and_in_blocks(spark):
    notice = ["This is the first line of a notice", "and this is its second line here", "which its third line brings to an end"]
    head = ["A header that all of them share", "with one more line below it here"]
    docs = [(i, "\n".join([*head, *(prose(i, k) for k in range(8)), *notice])) for i in range(30)]
    # one document's many edited copies, which hold the notice too
    for i in range(300):
        body = [prose("copied", k) for k in range(10)]
        body[i % 10] = prose("edit", i)
        docs.append((1000 + i, "\n".join(body + notice)))
    got = dropped(spark, docs, min_groups=10)
    assert all(got[i] == (head + notice if i < 1000 else notice) for i in got)


def test_fields_at_every_size(spark):
    first, last = ["Ada", "Bea", "Cid", "Dov", "Eli"], ["Fox", "Gray", "Hill", "Ives", "Jay", "Kerr", "Lane"]
    line = lambda i: f"This article was first published by {first[i % 5]} {last[i % 7]}"
    for size in (40, 150):  # each first name in 8 or 30 texts, each pair in 2 or 5
        docs = [(i, f"{prose(i, 1)}\n{line(i)}\n{prose(i, 2)}") for i in range(size)]
        got = dropped(spark, docs + [(1000 + i, docs[3][1]) for i in range(25)], min_groups=20)
        assert all(got[i] == [line(3 if i >= 1000 else i)] for i in got)


def test_licence_lines_of_a_small_table(spark):
    marks = ("Apache License", "MIT License", "GNU General", "All rights reserved", "CC BY-NC")
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = lambda docs: Counter(m for r in docs.collect() for m in marks if m in (r["text"] or ""))
    assert set(held(rows)) == set(marks)
    assert not held(line_templates.drop_recurring(rows, find=line_templates.boilerplate_lines))


def test_decontamination(spark, docs):
    item = "The quick brown fox jumps over the lazy dog while seven wizards count their silver coins"
    edited = item.replace("quick", "quack").replace("seven", "sevn").upper()
    broken = item.replace("quick brown fox jumps", "slow red hen walks").replace("silver coins", "empty bowls")
    bench = spark.createDataFrame([(1, item), (2, ""), (3, None), (4, "zq"), (None, item), (1, item)], "item_id long, text string")
    planted = [(1, f"before {item} after"), (2, f"x {edited.replace(' ', chr(10), 3)} y"), (3, broken), (4, "azqb"), (5, "a zq b"), (None, item), (6, None), (7, "")]
    rows = frame(spark, planted + [d for d in docs if d[0]])
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.matches(rows, bench).collect()}
    assert got == {(1, 1): 0, (2, 1): 2, (4, 4): 0, (5, 4): 0, (None, 1): 0}
    whole = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(rows, bench, whole_words=True).collect()}
    assert whole == got.keys() - {(4, 4)}
    blocks = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.matches(rows, bench, block_chars=50).collect()}
    assert blocks == got
    kept = decontaminate.clean(rows, bench)
    assert kept.columns == rows.columns and kept.count() == rows.count() - 5
    assert decontaminate.matches(empty(spark), bench).count() == 0
    assert decontaminate.matches(rows, bench.where("false")).count() == 0


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, e in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return min(row)


def test_pigeonhole_loses_nothing():
    import random

    r = random.Random(3)
    for _ in range(300):
        item = decontaminate.fold("".join(r.choice("abc ") for _ in range(r.randrange(10, 70))))
        passage = list(item)
        for _ in range(r.randrange(10)):
            k = r.randrange(len(passage) + 1)
            passage[k : k + r.randrange(2)] = r.choice(["", "d", "a"])
        text = decontaminate.fold("".join(r.choice("abcd ") for _ in range(20)) + "".join(passage) + "".join(r.choice("abcd ") for _ in range(20)))
        if not item:
            continue
        budget = decontaminate.Item(1, item, 15).budget
        found = decontaminate.search(decontaminate.matcher([(1, item)], 15), text)
        assert (1 in found) == (edits(item, text) <= budget)
        if found:  # the passage given is at the distance given
            distance, start, end = found[1]
            assert distance <= budget and levenshtein(item, text[start:end]) == distance


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, e in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return row[-1]


def test_decontamination_of_a_very_long_text(spark):
    """A passage at the very end of a long text, and an item longer than a block of the benchmark."""
    item = " ".join(f"word{i * 7919 % 1000}" for i in range(400))
    rows = frame(spark, [(1, "x " * 300_000 + item.replace("word5 ", "ward5 ")), (2, "x " * 300_000)])
    bench = spark.createDataFrame([(1, item), (2, "x y z")], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["end"]) for r in decontaminate.matches(rows, bench, block_chars=100).collect()]
    assert got == [(1, 1, 600_000 + len(item))]


def library_ids(path, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [np.array(e.ids + [2], "<u4") for e in t.encode_batch([x or "" for _, x in docs], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_equal_the_library(path, docs):
    odd = [(0, x) for x in ["  x", " \n\ny ", "a\n\n b  c", "don't 'quote' it's", "(word)'s 1234abc", "ABC Def!!'t", "a' b'", "'a", "İstanbul Ǆ'S", "<|endoftext|> x", "é à́ ñ,—.", "a  b \n c", "  ", "x×y÷z, É!"]]
    rows = docs + odd
    encoder = tokens.Encoder(path)
    for _ in range(2):  # the second time from the cache
        data, offsets = kernel.text_bytes(pa.array([t for _, t in rows], pa.string()))
        ids, bounds = tokens.with_end(*encoder.encode(data, offsets))
        for i, want in enumerate(library_ids(path, rows)):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == want.tolist(), rows[i]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_added_tokens_equal_a_plain_call(spark, path):
    from tokenizers import Tokenizer

    texts = ["one two", "one <|endoftext|> two", "<|endoftext|>", "", "a<|startoftext|>b<|endoftext|><|endoftext|>", "<|ENDOFTEXT|> X", "ends in <|endof", "text|> begins", "É\u00a0<|endoftext|>"]
    want = {i: [*Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    rows = tokens.token_rows(frame(spark, list(enumerate(texts))).coalesce(1), path).collect()
    size = len(rows[0]["ids"]) // rows[0]["n_tokens"]
    assert {r["doc_id"]: np.frombuffer(r["ids"], f"<u{size}").tolist() for r in rows} == want


def test_token_workers_give_memory_back(df, monkeypatch):
    """After each batch and at the end, as a worker that waits keeps what it holds beside those at work."""
    from types import SimpleNamespace

    import pyarrow as pa
    from pyspark import TaskContext

    from sievegrid.functions import memory

    runs, calls = [], []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema, *a: runs.append(run) or self)
    monkeypatch.setattr(TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    tokens.token_rows(df, WORDS)
    give = memory.give_back
    monkeypatch.setattr(memory, "give_back", lambda: calls.append(give()))
    batches = [pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([t])], names=["doc_id", "text"]) for i, t in enumerate(["one two", "", "three"])]
    got = list(runs[0](iter(batches)))
    assert [x for b in got for x in b.column(0).to_pylist()] == [0, 1, 2] and len(calls) == 4


def test_packing(spark, docs, df):
    pieces = packing.pack(df, WORDS, window=256)
    got = sorted(pieces.collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    at, by_doc = 0, defaultdict(list)
    for r in got:
        assert r["sequence_id"] * 256 + r["offset"] == at and r["offset"] + r["length"] <= 256 and r["length"] > 0
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        at += r["length"]
        by_doc[r["doc_id"]].append(r)
    want = Counter((i, x.tobytes()) for (i, _), x in zip(docs, library_ids(WORDS, docs)))
    whole, last = Counter(), None
    for r in got:
        last = (last or b"") + r["ids"] if r["start"] else r["ids"]
        if r["start"] + r["length"] == r["doc_tokens"]:
            whole[(r["doc_id"], last)] += 1
    assert whole == want
    full = packing.sequences(pieces, 256).collect()
    assert sum(r["n_tokens"] for r in full) == at and sorted(len(r["ids"]) // 4 for r in full)[-1] == 256
    assert all((len(r["ids"]) // 4).bit_count() == 1 for r in full)
    assert packing.pack(empty(spark), WORDS).collect() == []


def test_rans_coder():
    r = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5, 3), (513, 40), (200_000, 50_000)):
        ids = np.minimum(r.zipf(1.3, n), top - 1) if top > 1 else np.zeros(n, np.int64)
        freq = rans.frequencies(np.bincount(ids, minlength=top))
        coder = rans.Coder(freq)
        assert n == 0 or freq.sum() == 1 << rans.BITS
        block = rans.write_block(coder, [1, None], np.array([n, 0]), ids)
        names, lengths, back = rans.read_block(coder, block)
        assert names == [1, None] and lengths.tolist() == [n, 0] and (back == ids).all()
        if n > 100_000:
            step = rans.CHECK_STEPS * rans.LANES
            assert (rans.read_block(coder, block, 1)[2] == ids[2 * step :]).all()
            assert len(block) < 2 * n
            with pytest.raises(ValueError, match="checksum"):
                rans.read_block(coder, block[:500] + bytes([block[500] ^ 1]) + block[501:])


def test_rans_archive(spark, docs, df):
    path = rans.write_archive(df, BYTES, parts=3)
    got = sorted(rans.read_archive(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in docs), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        at += r["n_tokens"]
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == Counter((i, x.tobytes()) for (i, _), x in zip(docs, library_ids(BYTES, docs)))
    assert rans.read_archive(spark, rans.write_archive(empty(spark), BYTES)).collect() == []


def test_archive_needs_its_path_only(spark, docs, df):
    """A fresh session reads it, whole and from every checkpoint; a table that isn't its own is refused."""
    long = frame(spark, [d for d in docs if d[0] is not None] + [(9000 + i, " ".join(f"t{i}x{k}" for k in range(60_000))) for i in range(2)])
    path = rans.write_archive(long, BYTES, parts=1)
    fresh = spark.newSession()
    whole = b"".join(bytes(r["ids"]) for r in sorted(rans.read_archive(fresh, path).collect(), key=lambda r: r["start"]))
    step, total = rans.LANES * rans.CHECK_STEPS, len(whole) // 4
    assert total > 4 * step
    for low in [0, 5, *range(step, total, step), total - 1]:
        pieces = sorted(rans.read_range(fresh, path, low, min(total, low + step + 3)).collect())
        assert pieces[0]["start"] == low and b"".join(bytes(r["ids"]) for r in pieces) == whole[4 * low : 4 * (low + step + 3)]
    blocks, freq, bits = rans.opened(fresh, path)
    other = freq.copy()
    other[np.argmax(freq)] -= 1
    other[np.argmin(freq)] += 1
    with pytest.raises(ValueError, match="another table"):
        rans.read_block(rans.Coder(other, bits), bytes(blocks.first()["block"]))
    raw = rans.table_bytes(freq)
    with pytest.raises(ValueError, match="table checksum"):
        rans.table_of(raw[:50] + bytes([raw[50] ^ 1]) + raw[51:])


def brute_repeats(w, least):
    best = [0] * len(w)
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            k = 0
            while j + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    covered = set()
    for i, b in enumerate(best):
        if b >= least:
            covered |= set(range(i, i + b))
    longest = max(best, default=0)
    return (len(covered), longest) if longest >= least else (0, 0)


def test_quality_rules(spark, docs):
    run = " ".join(f"r{i}" for i in range(25))
    extra = [(5000, f"a b c {run} d e f {run} g\n{run}\n{run}"), (5001, "x " * 200), (5002, "one two three\nsame line\nsame line\n \n \nsame line"), (5003, "## $5 <b> & | * %"), (5004, (" ".join(f"u{i}" for i in range(100)) + " ") * 2)]
    rows = [d for d in docs if d[0] != 3008] + extra
    got = repetition.rules(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for i, t in rows:
        t = t or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        covered, longest = brute_repeats(w, repetition.MIN_REPEAT)
        kept = not failed and 100 * covered <= repetition.MAX_COVERED_PERCENT * len(w) and longest <= repetition.MAX_LONGEST
        want[i].append((i, len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), covered, longest, failed, kept))
    assert Counter(tuple(r[c] for c in repetition.COLUMNS) for r in got) == Counter(x for v in want.values() for x in v)
    assert repetition.rules(empty(spark)).collect() == []


def test_quality_classifier(spark, docs):
    import random

    r = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        text = " ".join("".join(r.choice("aeioudhlnrst") for _ in range(r.randrange(2, 8))) for _ in range(r.randrange(20, 120)))
        bad = i % 4 == 0
        rows.append((i, text.upper().replace(" ", "!! ") if bad and i % 8 else text.replace(" ", "*** ") if bad else text + "."))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(900, None), (901, ""), (None, rows[1][1]), rows[5], rows[5]]
    df, lf = frame(spark, rows), spark.createDataFrame([*labels, (None, 1, 0), (7777, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    learn = lf.where(~quality.held_out(F.col("doc_id")))
    assert all(zlib.crc32(str(x["doc_id"]).encode()) % 3 != 1 for x in learn.where("doc_id is not null").collect())
    voter = quality.fit(df, learn)
    got = quality.score(df, voter).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got)
    truth = {i: q for i, q, _ in labels}
    tested = [x for x in got if x["doc_id"] in truth and zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1]
    assert len(tested) > 50 and sum(x["predicted"] == truth[x["doc_id"]] for x in tested) / len(tested) >= 0.95
    assert {x["score"] for x in got if x["doc_id"] in (900, 901)} == {0.0}
    good = quality.keep_good(df, voter)
    assert good.columns == df.columns and good.count() == sum(x["predicted"] for x in got)
    assert quality.score(empty(spark), voter).collect() == []
    nothing = quality.fit(df, lf.where("false"))
    assert {x["score"] for x in quality.score(df.limit(3), nothing).collect()} == {0.5}


def test_voting_is_exact():
    """Blocked products give the neighbours that a plain search gives."""
    r = np.random.default_rng(4)
    rows, labels = r.random((40, 64)).astype(np.float32), np.arange(40) % 2
    voter = quality.Voter(rows, labels, latent=8, k=5)
    x = r.random((20, 64)).astype(np.float32)
    unit = lambda v: v / np.linalg.norm(v)
    for row, s in zip(x, voter.score(x)):
        v = unit(unit(row * voter.idf) @ voter.axes)
        cos = np.array([v @ y for y in voter.vectors])
        near = np.argsort(-cos)[:5]
        weight = np.maximum(cos[near], 0) ** 4 * voter.weight[near]
        assert s == pytest.approx((weight * labels[near]).sum() / weight.sum(), abs=1e-4)


def test_tied_neighbours_and_few_labels():
    """Equal labelled vectors: the fixed order settles which of them vote, so scores repeat."""
    rows = np.tile(np.array([[1.0, 2.0, 0.0, 3.0]], np.float32), (6, 1))
    voter = quality.Voter(rows, np.array([0, 1, 0, 1, 0, 1]), latent=2, k=3)
    once = voter.score(rows[:2])
    assert (once == voter.score(rows[:2])).all() and once[0] == once[1] and 0 <= once[0] <= 1
    assert len(quality.Voter(rows[:2], np.array([0, 1]), latent=2, k=9).score(rows)) == 6


def test_sha_of_kept_text(spark, df):
    row = substrings.remove_repeats(df.where("doc_id = 3005")).select(F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("s")).first()
    assert row["s"] == hashlib.sha256(b"a b c d").hexdigest()
