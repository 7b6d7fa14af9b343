"""Every operator on small awkward tables, against brute force."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from weftgraph.llm import bpe, chat, decontaminate, lm_score, pii, quality, repair, simhash, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, fp long, cell long, row long, word string, n int"
rng = random.Random(7)
WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rt", "st", "l")]


def sentence(n, r=rng):
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = sentence(150)
TEXTS = [
    None, "", "   \n ", "one", "one two", "Ünï çödé à la carte\xa0x", BASE, BASE, BASE.upper(), BASE + " end", "x" * 3000, sentence(4000),
    "mail a.b@c.example.org or +1 (650) 555-1234 or 10.0.0.1 and 4111 1111 1111 1111 <|endoftext|> \\### ok", "same line\n" * 60, "### $$$ %%% " * 40,
    *[sentence(80) for _ in range(25)],
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 1, 2, 3, "w", 4) for i, t in enumerate(TEXTS)]
    rows += [(6, TEXTS[6], "en", 1, 2, 3, "w", 4), (None, "a null id " * 30, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]


def all_docs(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


# --- 1
def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash_matches_brute_force(docs):
    got = rows(simhash.near_duplicates(docs))
    want = all_docs(docs)
    fps = [brute_fingerprint(t) for _, t in want]
    comps = brute_components([i for i, _ in want], fps)
    expect = Counter((i, f"{f:016x}", c) for (i, _), f, c in zip(want, fps, comps))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == expect


@pytest.mark.parametrize("pair_cell", [0, 3, 48])
def test_links_find_every_pair_within_two_bits(spark, pair_cell):
    r = random.Random(3)
    centre = [r.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4))) & (1 << 64) - 1 for c in centre for _ in range(60)} | {r.getrandbits(64) for _ in range(200)}
    fps = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), pair_cell=pair_cell).collect()
    at = {f: i for i, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
        root[find(at[a])] = find(at[b])
    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 2:
                assert find(i) == find(j)


def test_components_of_a_long_chain(spark):
    from weftgraph.llm.common import connected_components

    edges = spark.range(300).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.createDataFrame([(1000, 1001), (1001, 1001)], "a long, b long"))
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids))
    assert 6 in ids and 7 not in ids and 8 not in ids and None in ids


def test_keep_one_chooses_rows_not_ids(spark):
    one, other = sentence(60), sentence(60)
    table = [(2, one, 0), (5, one, 1), (5, other, 2), (5, other, 3), (9, other, 4), (None, one, 5), (None, None, 6), (7, None, 7), (8, "", 8)]
    kept = simhash.keep_one(spark.createDataFrame(table, "doc_id long, text string, kept_id int").repartition(3)).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None) == sorted([(2, one), (5, other), (7, None)])
    assert sorted(r.kept_id for r in kept if r.doc_id is None) == [5, 6]


# --- 2
def test_quality_figures_and_verdict(docs):
    for r in rows(quality.measure(docs)):
        t = next(x for i, x in all_docs(docs) if i == r["doc_id"])
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        often = Counter(zip(w, w[1:], w[2:]))
        covered = {k for i in range(len(w) - 2) if often[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r["n_words"] == len(w) and r["word_chars"] == sum(map(len, w)) and r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        every = [n for n, rule in quality.RULES.items() if rule.rejects(quality.Figures(t))]
        assert r["kept"] == (not every)


def test_cascade_order_changes_nothing(docs):
    for _, t in all_docs(docs):
        orders = [list(quality.RULES), list(quality.RULES)[::-1]]
        assert len({quality.rejected_by(quality.Figures(t), o) is None for o in orders}) == 1
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r["doc_id"] for r in rows(quality.measure(docs)) if r["kept"]}


def test_rules_are_ordered_by_rejections_per_cost():
    needs = {n: quality.Rule((n,), lambda f: False) for n in "abcd"}
    cost = {"a": 1.0, "b": 0.1, "c": 0.5, "d": 0.2}
    # b rejects 2 of 10 for 0.1, a 5 for 1; c nothing that a leaves; d nothing at all
    e = quality.Estimate(cost, {frozenset("ab"): 2, frozenset("ac"): 1, frozenset("a"): 2, frozenset(): 5})
    assert quality.cascade_order(e, needs) == ["b", "a", "d", "c"]
    shared = {"x": quality.Rule(("a",), lambda f: False), "y": quality.Rule(("a", "d"), lambda f: False), "z": quality.Rule(("c",), lambda f: False)}
    e = quality.Estimate({"a": 1.0, "d": 0.1, "c": 0.5}, {frozenset("x"): 6, frozenset("y"): 1, frozenset("z"): 2, frozenset(): 1})
    assert quality.cascade_order(e, shared) == ["x", "y", "z"]  # y costs little once x has computed a


def test_the_cascade_stops_early(docs):
    got = sorted(rows(quality.report(docs)), key=lambda r: r["place"])
    assert [r["rule"] for r in got] != [] and {r["rule"] for r in got} == set(quality.RULES)
    assert got[0]["asked"] == docs.count() and all(a["asked"] - a["rejected"] == b["asked"] for a, b in zip(got, got[1:])) and got[-1]["asked"] < docs.count()
    assert got[-1]["asked"] - got[-1]["rejected"] == sum(r["kept"] for r in rows(quality.measure(docs)))


# --- 3
def brute_spans(t):
    found = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and pii.luhn(d):
            found.append((m.start(), m.end(), 2))
    found += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.findall("[0-9]", m.group())) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_base_spans_match_the_patterns():
    r = random.Random(2)
    parts = ["a", "@", ".", "1", "25", "+", "-", " ", "(", ")", "é", "00", "4111111111111111", "x.y", "@b.c", "\n", "256", "1.2.3.4"]
    for _ in range(20_000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert pii.base_spans(t) == brute_spans(t)


def test_base_spans_of_long_runs_are_quick():
    for t in ("1" * 200_000, "a@" * 100_000, "1." * 100_000, "+1" + " " * 200_000, "a" * 200_000 + "@"):
        pii.base_spans(t)


def test_personal_data_columns(docs):
    for r in rows(pii.find(docs)):
        t = next(x for i, x in all_docs(docs) if i == r["doc_id"])
        base = brute_spans(t)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) <= set(r["spans"].split(","))


def test_contextual_patterns_discover_unseen_identifiers(spark):
    seeds = [(i, f"write to agent-mail: user{i}@host{i}.example.com today") for i in range(12)]
    more = [(100, "write to agent-mail: someone77(at)host today"), (101, "there are 1234abc apples in 55555 baskets")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(seeds + more, "doc_id long, text string")).collect()}
    assert got[100].startswith("email:21:") and got[101] == ""


def test_long_tokens_and_many_spans_are_looked_at():
    blob = "x" * 500 + "7" + "y" * 500
    assert list(pii.candidates(f"key {blob} end", [])) == [(4, 4 + len(blob))]
    assert list(pii.candidates("a1b2c3" * 30_000, [])) == [(0, 180_000)]
    long = (0, 30, 3)
    assert list(pii.candidates("0" * 26 + "12345 67890", [long, *((i, i + 1, 1) for i in range(1, 20))])) == [(32, 37)]


def test_joined_patterns_give_the_same_spans(spark, docs):
    seeds = [(i, f"write to agent-mail: user{i}@host{i}.example.com today") for i in range(12)] + [(i, f"caller number: +1650555{i:04d} end") for i in range(20, 32)]
    more = [(100, "write to agent-mail: someone77(at)host today"), (101, "there are 1234abc apples"), (102, "caller number: 5551234 end caller number: 5551235 end"), (100, "write to agent-mail: someone77(at)host today"), (None, "caller number: 777777 end"), (103, None)]
    df = spark.createDataFrame([(*x, "extra") for x in seeds + more], "doc_id long, text string, text_digest string").unionByName(docs.select("doc_id", "text", docs.lang.alias("text_digest")))
    key = lambda r: (r.doc_id is not None, r.doc_id, r.spans)
    by_model, by_join = (sorted(pii.find(df, most=n).collect(), key=key) for n in (1000, 0))
    assert by_model == by_join and sum("phone:15:" in r.spans for r in by_model) > 12
    masks = [sorted((str(r.doc_id), r.text or "", r.text_digest or "") for r in pii.mask(df, most=n).collect()) for n in (1000, 0)]
    assert masks[0] == masks[1] and any("caller number: <phone> end caller number: <phone> end" in x[1] for x in masks[0])


def test_masking(docs):
    out = pii.mask(docs)
    assert out.columns == docs.columns
    assert "mail <email> or <phone> or <ip> and <card> " in out.where("doc_id = 12").first().text


# --- 4
def stored(base, sizes, parts):
    return repair.Shard(base, np.cumsum(sizes).tolist(), *map(repair._pack, (*parts, repair.sample_offsets(base, parts[2], parts[3]))))


def frequent_left(seq, least):
    often, last = Counter(), {}
    for i, pair in enumerate(zip(seq, seq[1:])):  # uses that don't overlap
        if last.get(pair, -2) < i - 1:
            often[pair], last[pair] = often[pair] + 1, i
    return [p for p, n in often.items() if n >= least]


def test_grammar_round_trip(monkeypatch):
    monkeypatch.setattr(repair, "SAMPLE", 4)
    r = random.Random(4)
    for _ in range(300):
        x = np.array([r.randint(0, r.randint(0, 4)) for _ in range(r.randint(0, 400))], np.uint32)
        least = r.randint(2, 8)
        parts = repair.compress(x, 5, least)
        assert not frequent_left(parts[3].tolist(), least)
        sizes, left = [], len(x)
        while left:
            sizes.append(r.randint(1, min(30, left)))
            left -= sizes[-1]
        shard = stored(5, sizes, parts)
        assert shard.all().tolist() == x.tolist()
        at = 0
        for k, n in enumerate(sizes):
            assert shard.document(k) == x[at : at + n].tolist()
            at += n


def test_grammar_leaves_no_frequent_pair():
    r = np.random.default_rng(4)
    phrases = [r.integers(0, 5000, r.integers(2, 40)) for _ in range(3000)]
    x = np.concatenate([phrases[i] for i in r.integers(0, 3000, 20_000) ** 2 // 3000]).astype(np.uint32)
    for ids in (x, np.zeros(1000, np.uint32), r.integers(0, 3, 3000).astype(np.uint32)):
        parts = repair.compress(ids, 5000)
        assert not frequent_left(parts[3].tolist(), repair.LEAST_USES) and len(parts[3]) < len(ids) / 2
        assert stored(5000, [len(ids)], parts).all().tolist() == ids.tolist()
    assert len(repair.compress(np.zeros(1 << 12, np.uint32), 1)[3]) < repair.LEAST_USES * 2


def test_a_document_is_read_from_the_symbols_around_it():
    x = np.tile(np.arange(1000, dtype=np.uint32), 300)
    parts = repair.compress(x, 1000)
    shard = stored(1000, [100] * 3000, parts)
    looked = []
    between = shard.grammar.between
    shard.grammar.between = lambda symbols, begin, end: looked.append(len(symbols)) or between(symbols, begin, end)
    assert shard.document(1777) == x[177_700:177_800].tolist() and looked[0] <= 2 * repair.SAMPLE


def test_deep_rules_expand_without_passes_over_plain_ids():
    base, deep, plain = 10, 5_000, 200_000
    chain = np.arange(base - 1, base + deep - 1, dtype=np.int32)  # each rule is the one before and a 3, the first a 9 and a 3
    grammar = repair.Grammar(base, chain, np.full(deep, 3, np.int32), np.arange(2, deep + 2, dtype=np.int32))
    ids = np.arange(plain, dtype=np.int32) % base
    began = time.process_time()
    got = grammar.expand(np.concatenate((ids, np.array([base + deep - 1], np.int32), ids)))
    assert time.process_time() - began < 2
    assert np.array_equal(got, np.concatenate((ids, [9], np.full(deep, 3), ids)))
    many = np.full(10_000, base + 49, np.int32)  # here the rules' ids are fewer than the result's
    short = repair.Grammar(base, chain[:50], grammar.right[:50], grammar.lengths[:50])
    assert np.array_equal(short.expand(many), np.tile([9] + [3] * 50, 10_000)) and len(short.expand(many[:0])) == 0



def test_pairs_of_wide_symbols_are_grouped_without_packing():
    seq = np.array([7, 9, 7, 9, 7, 7], np.uint32)
    for most in (16, 1 << 31):
        at, first = repair._grouped(seq, np.arange(5), most)
        assert [x.tolist() for x in np.split(at, first[1:])] == [[4], [0, 2], [1, 3]]


def test_files_hold_all_ids_in_order(docs, spark, tmp_path):
    lib = bpe.load_tokenizer(bpe.tokenizer_path())
    path = str(tmp_path / "ids")
    repair.write_ids(docs, path, parts=4, shard_tokens=700)
    got = sorted(rows(repair.read_ids(spark, path)), key=lambda r: r["start"])
    assert sum(r["n_tokens"] for r in got) == got[-1]["start"] + got[-1]["n_tokens"]
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in all_docs(docs)), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        t = next(x for i, x in all_docs(docs) if i == r["doc_id"])
        ids = [*lib.encode(t, add_special_tokens=False).ids, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    want = [*lib.encode(TEXTS[11], add_special_tokens=False).ids, 0]
    assert repair.fetch(spark, path, 11) == [want] and len(repair.fetch(spark, path, 6)) == 2 and repair.fetch(spark, path, 999) == []


# --- 5, 10
ODD = ["a", "b", " ", "  ", "\n", "\t", "à", "\xa0", "'s", "'", "<|endoftext|>", "1", "é", "　", "\x1c", "!", "the", "🙂", "\0", " \0", "\r\n", "x" * 70]


def test_encoding_is_the_librarys():
    b = bpe.ByteBpe(bpe.tokenizer_path(), memo_fragments=200)
    r = random.Random(1)
    for _ in range(4000):
        t = "".join(r.choice(ODD) for _ in range(r.randint(0, 14)))
        ids = np.frombuffer(b.encode_many([t])[0], "<u4").tolist()
        want = b.lib.encode(t, add_special_tokens=False).ids
        assert ids == want and b.decode(ids) == b.lib.decode(want, skip_special_tokens=False), repr(t)
    assert b.decode([255, 50256]) == b.lib.decode([255, 50256], skip_special_tokens=False)


def test_certain_cuts_are_in_no_token():
    b = bpe.byte_bpe(bpe.tokenizer_path())
    for piece in b.pieces[:50256]:
        assert not any(b.certain[x, y] or b.free[x, y] for x, y in zip(piece, piece[1:]))
    for special in b.added:
        assert not any(b.free[x, y] for x, y in zip(special, special[1:]))


def test_cuts_inside_runs_change_no_id():
    import base64

    b = bpe.ByteBpe(bpe.tokenizer_path())
    r = random.Random(23)
    blocks = [[chr(c) for c in range(a, z + 1)] for a, z in bpe.CUT_BLOCKS]
    odd = ["'", "'s", "'re", "'ll", "'ve", "'t", "<|endoftext|>", "!", "_", "\u0301", "²", "Ⅷ", "🙂", "ǅ", "ß", "l", "e", "\xa0"]
    texts = [base64.b64encode(r.randbytes(3000)).decode(), "".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(3000)), "".join(chr(r.randint(0xAC00, 0xD7A3)) for _ in range(3000)), r.randbytes(2000).hex()]
    for _ in range(1500):
        some = [r.choice(blocks) for _ in range(3)]
        texts.append("".join(r.choice(odd) if r.random() < 0.1 else r.choice(r.choice(some)) for _ in range(r.randint(65, 160))))
    cuts = 0
    for t in texts:
        parts = b.cut(t)
        cuts += len(parts) - 1
        assert "".join(parts) == t
        assert [i for p in parts for i in b.lib.encode(p, add_special_tokens=False).ids] == b.lib.encode(t, add_special_tokens=False).ids, t
        assert np.frombuffer(b.encode_many([t])[0], "<u4").tolist() == b.lib.encode(t, add_special_tokens=False).ids
    assert cuts > 20_000 and all(max(map(len, b.cut(t))) < 300 for t in texts[:3])


def test_resynchronised_counts():
    b = bpe.byte_bpe(bpe.tokenizer_path())
    r = random.Random(5)
    for _ in range(600):
        t = "".join(r.choice(ODD) for _ in range(r.randint(0, 120)))
        assert token_counts.count_resynchronised(b, t, 30, 6) == len(b.lib.encode(t, add_special_tokens=False)), repr(t)
    for t in ("x" * 5000, "a " * 3000, "ab\xa0 " * 900, " " * 4000):
        assert token_counts.count_resynchronised(b, t, 256, 16) == len(b.lib.encode(t, add_special_tokens=False))


def test_token_count_and_digest_columns(docs):
    lib = bpe.load_tokenizer(bpe.tokenizer_path())
    by_id = dict(all_docs(docs))
    for r in rows(token_counts.token_counts(docs, chunk=500, overlap=20)):
        n = len(lib.encode(by_id[r["doc_id"]], add_special_tokens=False))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(by_id[r["doc_id"]].encode()), n, n > 512)
    for r in rows(bpe.encode_digests(docs)):
        ids = lib.encode(by_id[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(by_id[r["doc_id"]].encode()).hexdigest()
    out = bpe.with_ids(docs)
    assert out.columns == [*docs.columns, "n_tokens", "token_ids", "decodes"] and out.where("NOT decodes").isEmpty()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_by_other_tokenizers(name):
    count = token_counts.counter(bpe.tokenizer_path(name))
    assert count(["", "one two three", "été"])[0] == 0 and all(count(["one two three"]))


# --- 6
def test_base_scores_match_brute_force(docs):
    by_id = {i: t for i, t in all_docs(docs)}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for i, t in all_docs(docs):
        if not held(i):
            counts.update([*t.encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for r in rows(lm_score.score(docs)):
        tokens = [*by_id[r["doc_id"]].encode().lower().split(), None]
        assert r["held_out"] == held(r["doc_id"]) and r["n_tokens"] == len(tokens) and r["train_tokens"] == n
        assert r["n_known"] == sum(counts[x] > 0 for x in tokens)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens), abs_tol=1e-6)
        assert r["score"] < 0


def test_filter_levels():
    r = np.random.default_rng(0)
    keys, pairs = (r.integers(0, 1 << 48, 20_000).astype(np.uint64) for _ in range(2))
    levels, pair_levels = (r.integers(1, 6, 20_000).astype(np.uint8) for _ in range(2))
    f = lm_score.LogFrequencyFilter.build(keys, levels, pairs, pair_levels)
    assert f.size < 10 * (int(levels.sum()) + int(pair_levels.sum())) + 64
    for k, q, kind in ((keys, levels, False), (pairs, pair_levels, True)):
        found = f.levels(k, kind)
        assert (found >= q).all() and (found == q).mean() > 0.97
        assert (f.levels(r.integers(0, 1 << 63, 20_000).astype(np.uint64), kind) == 0).mean() > 0.97


def test_levels_follow_counts():
    n = np.arange(1, 5000)
    q = lm_score.level(n)
    assert q[0] == 1 and (np.diff(q.astype(int)) >= 0).all() and (np.diff(q.astype(int)) <= 1).all() and lm_score.level(np.array([1 << 60]))[0] <= len(lm_score._STEPS)


def test_keys_and_counts_are_packed_whole():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 500):
        for top in (1, 255, 256, 1 << 33, (1 << 64) - 1):
            x = np.sort(r.integers(0, top, n, dtype=np.uint64, endpoint=True))
            assert (lm_score._unpack(lm_score._pack(x)) == x).all() and (lm_score._unpack_keys(lm_score._pack_keys(x)) == x).all()


def brute_lm(table):
    """doc_id -> score from exact counts, quantised by the means of their levels."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = lambda t: [*t.encode().lower().split(), "end"]
    words, pairs, texts = Counter(), Counter(), 0
    for i, t in table:
        if not held(i):
            words.update(split(t))
            pairs.update(zip(["start", *split(t)], split(t)))
            texts += 1
    n, v = sum(words.values()), len(words)

    def quantised(c):
        by = {}
        for x in c.values():
            by.setdefault(int(lm_score.level(np.array([x]))[0]), []).append(x)
        mean = {q: sum(xs) / len(xs) for q, xs in by.items()}
        once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
        return {k: mean[int(lm_score.level(np.array([x]))[0])] for k, x in c.items()}, (once / (once + 2 * twice) if once else 0)

    (wq, wd), (pq, pd) = quantised(words), quantised(pairs)
    reserved = max(pd * len(pairs) / max(1, n), 1e-9)
    out = {}
    for i, t in table:
        total = 0.0
        for a, b in zip(["start", *split(t)], split(t)):
            p = (wq[b] - wd) / n if b in words else max(wd * v / max(1, n), 1 / (n + v + 1))
            c = texts if a == "start" else wq.get(a, 0)
            total += math.log10(min(1, max(pq.get((a, b), pd) - pd, 0) / c) + reserved * p if c else p)
        out[i] = total
    return out


def test_scores_match_exact_counts(spark):
    """Hot n-grams, segments and blocks of any number change nothing; with a wide filter hardly a probe is false."""
    r = random.Random(12)
    table = [(i, sentence(r.randint(0, 60), r)) for i in range(60)] + [(100, ""), (101, "nothing known here"), (102, sentence(3000, r))]
    want = brute_lm(table)
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    for share, segment, block in ((1 << 17, 1 << 20, 8_000_000), (200, 300, 4000), (1, 50, 10)):
        coded = lm_score.materialise(lm_score.code(df, block_chars=block))
        model, segments = lm_score.learn(coded, 3000, share, segment)
        got = {x["doc_id"]: x["score"] for x in rows(lm_score.score_coded(coded, model, segments))}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_pairs_of_rare_words_count(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(6000)]  # each one token in 18,000: far from frequent
    texts = []
    for _ in range(3):
        order = [words[i : i + 100] for i in range(0, 6000, 100)]
        r.shuffle(order)
        texts += [" ".join(x) for x in order]
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2][: len(texts)]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    known = words[:100]
    mixed = r.sample(known, 100)
    table = [*zip(train, texts), (held[0], " ".join(known)), (held[1], " ".join(mixed))]
    got = {x["doc_id"]: x["score"] for x in rows(lm_score.score(spark.createDataFrame(table, "doc_id long, text string")))}
    assert got[held[0]] > got[held[1]] + 100


def test_without_training_documents(spark):
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = rows(lm_score.score(spark.createDataFrame([(i, "a b")], "doc_id long, text string")))
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)


# --- 7
def brute_hits(texts, items):
    """(text, item) -> score, of every window of every text against every item."""
    stats = decontaminate.Statistics.of([t for _, t in items])
    found = {}
    for i, item in items:
        ws = decontaminate.terms(item)
        impact = {}
        for w, tf in Counter(ws).items():
            idf = math.log(1 + (stats.items - stats.df[w] + 0.5) / (stats.df[w] + 0.5))
            impact[w] = idf * tf * (decontaminate.K1 + 1) / (tf + decontaminate.K1 * (1 - decontaminate.B + decontaminate.B * len(ws) / stats.mean))
        halves = [decontaminate.grams(h) for h in decontaminate.question_and_answer(item)]
        stride = decontaminate.stride_of(len(ws))
        for d, t in enumerate(texts):
            w = decontaminate.terms(t)
            for b in range(0, len(w), stride):
                passage = w[b : b + 2 * stride]
                score = sum(impact.get(x, 0) for x in set(passage)) / (decontaminate.SHARE * sum(impact.values()))
                shares = [len(g & set(zip(*[passage[k:] for k in range(len(next(iter(g), ())))]))) / len(g) if g else 1.0 for g in halves]
                if score >= 1 and shares[0] >= decontaminate.QUESTION_SHARE and shares[1] >= decontaminate.ANSWER_SHARE:
                    found[d, i] = max(found.get((d, i), 0), score)
    return found


def test_index_finds_what_brute_force_finds(monkeypatch):
    r = random.Random(9)
    items = [(i, sentence(r.randint(8, 30) if i else 400, r).capitalize() + ". " + sentence(6, r) + ".") for i in range(40)]
    texts = [sentence(r.randint(0, 300), r) for _ in range(60)]
    texts = [t + " " + items[k % 40][1] + " " + sentence(40, r) if k % 3 == 0 else t for k, t in enumerate(texts)] + ["", None]
    # half of an item's words: near the threshold from either side
    texts += [" ".join(w for w in items[k][1].split() if r.random() < 0.8) for k in range(40)]
    want = brute_hits(texts, items)
    for most, dense in ((4_000_000, 1 << 20), (50, 0)):
        monkeypatch.setattr(decontaminate, "MOST_SUMS", most)
        monkeypatch.setattr(decontaminate, "MOST_DENSE", dense)
        got = {(d, i): s for d, i, s, _, _ in decontaminate.Benchmark(items).hits(texts)}
        assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}
    assert all((d, d % 40) in got for d in range(0, 60, 3)) and len({d for d, _ in got if d >= 62}) > 5


def test_search_alone_finds_all_above_threshold():
    r = random.Random(19)
    items = [(i, sentence(20, r)) for i in range(30)]
    (ix,) = (b := decontaminate.Benchmark(items)).indexes
    for _ in range(200):
        query = sorted({b.vocab[w] for w in sentence(r.randint(1, 40), r).split() if w in b.vocab})
        scores = Counter()
        for t in query:
            for i, x in zip(*ix.postings(t)[:2]):
                scores[i] += x
        assert {i: round(x, 9) for i, x in ix.search(query)} == {i: round(x, 9) for i, x in scores.items() if x >= 0.9999}


def test_the_parts_of_a_benchmark_change_nothing(spark, monkeypatch, docs):
    r = random.Random(29)
    items = [(i, sentence(r.randint(10, 60), r) + ". " + sentence(9, r) + ".") for i in range(30)] + [(40, None), (41, "")]
    bench = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, doc_id string")
    edited = [" ".join(w if r.random() < 0.85 else "zz" for w in t.split()) for _, t in items[:30]]
    more = spark.createDataFrame([(500 + k, sentence(90) + " " + t, "en", 1, 2, 3, "w", 4) for k, t in enumerate(edited)], SCHEMA)
    both = docs.unionByName(more)
    one = sorted((x.doc_id, x.item_id, round(x.score, 9)) for x in decontaminate.contaminated(both, bench).collect())
    left = sorted((x.doc_id is not None, x.doc_id) for x in decontaminate.drop_contaminated(both, bench).collect())
    monkeypatch.setattr(decontaminate.benchmarks, "__defaults__", ("item_id", "text", 1500))
    assert one == sorted((x.doc_id, x.item_id, round(x.score, 9)) for x in decontaminate.contaminated(both, bench).collect()) and 5 < len(one) < 30
    out = decontaminate.drop_contaminated(both, bench)
    assert out.columns == docs.columns and sorted((x.doc_id is not None, x.doc_id) for x in out.collect()) == left
    assert len(left) == docs.count() + 30 - len({d for d, _, _ in one})
    none = bench.limit(0)
    assert decontaminate.contaminated(docs, none).count() == 0 and decontaminate.drop_contaminated(docs, none).count() == docs.count() and decontaminate.drop_contaminated(docs.limit(0), bench).count() == 0


def test_an_index_is_sparse():
    import pickle

    r = random.Random(3)
    items = [(i, " ".join(f"w{int(30_000 * r.random() ** 3)}" for _ in range(20))) for i in range(7_000)]
    made = decontaminate.Benchmark(items)
    assert len(pickle.dumps(made)) < 25 * sum(len(t) for _, t in items)


# --- 8
def test_chat_round_trip(spark):
    said = [("user", chat.TRAP), ("assistant", "a\\b\\h ### </turn>\n### x: "), (None, None), ("a:b\\", "")]
    turns = [(1, k, r, t, "x") for k, (r, t) in enumerate(said)] + [(2, 0, "user", "only"), (None, 5, "assistant", "null id"), (1, 1, *said[1], "x")[:5], (2, 0, "user", "only", "x")[:5]]
    turns = [t if len(t) == 5 else (*t, "x") for t in turns]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, msg string")
    back = {r.tree: [tuple(t) for t in r.turns] for r in chat.read_back(chat.format_trees(chat.as_reply_trees(df))).collect()}
    ordered = [(a or "", b or "") for a, b in (said[0], said[1], said[1], said[2], said[3])]
    assert back == {1: ordered, 2: [("user", "only")] * 2, None: [("assistant", "null id")]}
    got = {r.conv_id: r for r in chat.conversation_digests(df).collect()}
    assert got[1].loss_sha256 == hashlib.sha256((said[1][1] * 2).encode()).hexdigest() and got[1].loss_chars == 2 * len(said[1][1])
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in ordered).encode()).hexdigest()


def test_branches_are_ranked_by_score(spark):
    rows_ = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 2.0), (1, 4, 2, 5.0), (1, 5, 3, 1.0), (1, 6, 99, 1.0), (2, 1, None, 0.0)] + [(3, i, i - 1 or None, 1.0) for i in range(1, 40)]
    df = spark.createDataFrame([(t, m, p, "user", f"m{m}", s) for t, m, p, s in rows_], "tree long, msg long, parent long, role string, text string, score double")
    got = {}
    for r in sorted(chat.paths(df, 2).collect(), key=lambda r: r["at"]):
        got.setdefault((r.tree, r.branch), []).append(r.msg)
    assert got == {(1, 1): [1, 2, 4], (1, 2): [1, 3, 5], (2, 1): [1], (3, 1): list(range(1, 40))}


def test_trees_with_nulls_and_repeated_rows(spark):
    """Each message stands once in its path, whatever repeats; nulls count as empty; columns may have any names."""
    kind = "tree long, msg long, parent long, role string, text string, score double, rank string, t long"
    messages = [(1, 1, None, "user", "q", None), (1, 1, None, "user", "q", None), (1, 2, 1, "assistant", "b", 1.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 2, None, None, 0.0), (1, 3, 2, None, None, 0.0), (1, None, 1, "user", "lost", 9.0), (None, 1, None, "user", "", 0.0)]
    df = spark.createDataFrame([(*m, "x", 7) for m in messages], kind)
    back = {r.tree: [tuple(t) for t in r.turns] for r in chat.read_back(chat.format_trees(df)).collect()}
    assert back == {1: [("user", "q"), ("assistant", "a"), ("", "")], None: [("user", "")]}
    assert chat.format_trees(df.limit(0)).count() == 0 == chat.paths(df.limit(0)).count()


def test_ties_go_to_the_smaller_leaf(spark):
    df = spark.createDataFrame([(1, 1, None, "user", "q", 0.0), (1, 3, 1, "assistant", "c", 2.0), (1, 2, 1, "assistant", "b", 2.0)], "tree long, msg long, parent long, role string, text string, score double")
    assert [r.turns[1].text for r in chat.read_back(chat.format_trees(df, 2)).orderBy("branch").collect()] == ["b", "c"]


def test_replies_in_a_circle(spark):
    df = spark.createDataFrame([(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0)], "tree long, msg long, parent long, role string, text string, score double")
    with pytest.raises(ValueError, match="circle"):
        chat.paths(df)


# --- 9
def brute_clauses(text, insults, weights):
    """The score by the rules as they are written, without machines."""
    total = 0.0
    word_class = toxicity.Scorer(insults).classify
    for clause in re.split(r"[.!?;:\n]", text.lower()):
        words = [word_class(w) for w in re.findall(r"[^\W\d_]+", clause)]
        kinds = [k for k, _ in words]
        attacks = [i for i, k in enumerate(kinds) if k in toxicity.ATTACK]
        insult = toxicity.INSULT in kinds and set(kinds) != {toxicity.INSULT}
        threat = toxicity.THREAT in kinds and toxicity.TARGET in kinds
        if not insult and not threat:
            continue
        w = max(x for k, x in words if k == toxicity.INSULT) if insult else 0.0
        w += weights["threat"] * threat + weights["target"] * (insult and toxicity.TARGET in kinds)
        w += weights["negation"] * all(toxicity.NEGATION in kinds[max(0, i - 2) : i] for i in attacks)
        w += weights["report"] * all(toxicity.REPORT in kinds[:i] for i in attacks)
        total += math.exp(w)
    return total


def test_grammar_scores_clauses():
    s = toxicity.Scorer({"clod": 0.0, "dumb*": -0.1})
    plain = s.clauses("the clod sleeps")
    assert s.clauses("you clod") > plain > s.clauses("they are never a clod") > 0
    assert plain > s.clauses("it was said a clod sleeps") > 0 and s.clauses("dumbly so") > 0 and s.clauses("nothing here. at all") == 0
    assert s.clauses("she said. the clod sleeps") == plain  # a new clause forgets what was reported
    assert s.clauses("clod") == s.clauses("clod. Dumbly!") == 0  # words that stand alone are no clauses
    assert s.clauses("i will kill you") == s.clauses("you i will kill") > 0 == s.clauses("kill it") == s.clauses("kill it. you")


def test_grammar_matches_the_rules():
    r = random.Random(31)
    insults, weights = {"clod": -0.2, "oaf": -0.6}, {"threat": 0.3, "target": 0.5, "negation": -0.9, "report": -0.4}
    s = toxicity.Scorer(insults, weights)
    for _ in range(20_000):
        t = " ".join(r.choice(["clod", "oaf", "you", "not", "said", "kill", "tree", "."]) for _ in range(r.randint(0, 9)))
        assert math.isclose(s.clauses(t), brute_clauses(t, insults, weights), abs_tol=1e-12), t


def test_weights_follow_the_clauses():
    plain, told = frozenset({"insult"}), frozenset({"insult", "report"})
    none = toxicity.choose_weights({})
    assert none == toxicity.PRIOR
    more = toxicity.choose_weights({(plain, 1): 900, (plain, 0): 100, (told, 1): 50, (told, 0): 950})
    assert more["report"] < -4 and more["target"] == none["target"]
    few = toxicity.choose_weights({(plain, 1): 900, (plain, 0): 100, (told, 0): 1})
    assert none["report"] > few["report"] > more["report"]


def test_the_layout_of_files_changes_no_score(spark):
    r = random.Random(13)
    bad = ["blorgh", "znurk"]
    texts = [sentence(20, r) + (" you " + r.choice(bad) + " " + sentence(5, r) if i % 4 == 0 else "") for i in range(60)]
    table = [(i, texts[i % 60] if i % 3 else texts[i % 7]) for i in range(300)]  # copies
    df = spark.createDataFrame(table, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(any(b in t for b in bad))) for i, t in table], "doc_id long, quality int, toxic int")
    one, many = ({x["doc_id"]: x["score"] for x in rows(toxicity.score(df.repartition(n), labels.repartition(n)))} for n in (1, 16))
    assert one == many and 0 < sum(x > 0.3 for x in one.values()) < 300


def test_toxicity_learns_from_training_rows(spark):
    r = random.Random(11)
    bad = ["blorgh", "znurk", "quiffel"]
    texts = [(i, sentence(60, r) + (" " + " ".join(r.sample(bad, 2)) + " " + sentence(10, r) if i % 5 == 0 else "")) for i in range(400)] + [(1000, None), (1001, ""), (None, "x")]
    docs_ = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for x in rows(toxicity.score(docs_, labels)):
        i = x["doc_id"]
        assert x["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= x["score"] <= 1
        assert x["predicted"] == int(i is not None and i < 400 and i % 5 == 0) == int(x["score"] >= 0.3)
    none = toxicity.score(docs_, labels.limit(0))
    assert none.where("predicted = 1").isEmpty()


# --- all
def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for df in (
        simhash.near_duplicates(empty), quality.measure(empty), pii.find(empty), repair.round_trip(empty), token_counts.token_counts(empty), lm_score.score(empty),
        decontaminate.contaminated(empty, bench), chat.conversation_digests(turns), toxicity.score(empty, labels), bpe.encode_digests(empty), simhash.keep_one(empty), quality.keep_good(empty), pii.mask(empty), bpe.with_ids(empty), decontaminate.drop_contaminated(empty, bench),
    ):
        assert df.count() == 0
