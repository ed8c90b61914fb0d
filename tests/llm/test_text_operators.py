"""Operators on texts against brute force on small tables with every odd case."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import ALNUM, LOWER, SCHEMA, WORD, documents, prose, texts

from spreadrank.llm import kernels as K
from spreadrank.llm import decontamination, fm_index, jaccard_join, quality_rules, substring_dedup, token_output
from spreadrank.llm.frames import scratch

ROWS = texts()
PLAIN = ROWS + [ROWS[0], (None, ROWS[4][1]), (None, None)]


def labels(spark, rows=((0, 1, 0), (3, 1, None), (6, 0, 0), (9, 1, 0), (9, 0, 0), (12, None, 0), (None, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_base_counts_and_scores(spark):
    got = collections.defaultdict(list)
    for r in quality_rules.quality_rules(documents(spark), labels(spark)).collect():
        got[r["doc_id"]].append(r)
    for d, t in PLAIN:
        w = WORD.findall(t or "")
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        tri = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(again))
        match = [r for r in got[d] if (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want]
        assert match, (d, want)
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        assert all(r["base_failed"] == failed and r["kept"] == (not failed and r["llr"] >= quality_rules.THRESHOLD) for r in match)
    assert sum(map(len, got.values())) == len(PLAIN)


def test_log_ratios_find_junk(spark):
    rng = random.Random(1)
    good = [(i, prose(rng, 120)) for i in range(150)]
    junk = [(1000 + i, " | ".join(f"z{rng.randrange(30)}%%%" for _ in range(120))) for i in range(40)]
    lab = labels(spark, [(d, 1, 0) for d, _ in good[:100]] + [(d, 0, 0) for d, _ in junk[:20]])
    ratio = quality_rules.log_ratios(documents(spark, good + junk, repeat=False), lab)
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(documents(spark, good + junk, repeat=False), lab).collect()}
    assert max(rows[d]["llr"] for d, _ in junk) < min(rows[d]["llr"] for d, _ in good) and ratio.shape == (quality_rules.BUCKETS,)
    assert all(rows[d]["kept"] for d, _ in good)


def test_log_ratios_against_counting(spark):
    rows = [(i, t) for i, t in enumerate(["a b c a", "a b", None, "x y z", "a"])]
    lab = labels(spark, [(0, 1, 0), (1, 1, 1), (3, 0, 0), (4, 1, None)])
    trusted, raw = collections.Counter(), collections.Counter()
    grams = {}
    for i, t in rows:
        col = pa.array([t], pa.string())
        bucket, _ = quality_rules.ngram_buckets(K.words_of(col))
        grams[i] = bucket.tolist()
        raw.update(grams[i])
        trusted.update(grams[i] if i in (0, 4) else [])
    size, prior = quality_rules.BUCKETS, quality_rules.PRIOR * quality_rules.BUCKETS
    p = lambda b: (raw[b] + 0.5) / (sum(raw.values()) + 0.5 * size)
    ratio = lambda b: np.log((trusted[b] + prior * p(b)) / (sum(trusted.values()) + prior) / p(b))
    got = {r["doc_id"]: r["llr"] for r in quality_rules.quality_rules(documents(spark, rows, repeat=False), lab).collect()}
    for i, own in grams.items():
        assert abs(got[i] - (np.mean([ratio(b) for b in own]) if own else 0)) < 1e-8


def test_no_labels_and_no_documents(spark):
    empty = spark.createDataFrame([], SCHEMA)
    none = labels(spark, [(1, None, None)]).limit(0)
    assert quality_rules.quality_rules(empty, none).count() == 0
    assert all(r["llr"] == 0 for r in quality_rules.quality_rules(documents(spark), none).collect())


def jaccard_classes(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and rows[a][0] is not None and rows[b][0] is not None and 100 * len(x & y) >= 85 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), (None if d is None else least[find(i)] if sets[i] else d)) for i, (d, _) in enumerate(rows)]


def same_rows(got, want):
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


@pytest.mark.parametrize("seed", [0, 1])
def test_jaccard_classes(spark, seed):
    rows = texts(seed)
    rows += [rows[0], (None, rows[4][1]), (None, None)]
    got = jaccard_join.jaccard_join(documents(spark, rows, repeat=False)).select("doc_id", "n_shingles", "component_id").collect()
    same_rows(got, jaccard_classes(rows))


def test_jaccard_of_a_large_family(spark):
    """Hundreds of copies with edits around the threshold, a passage that all share, and copies of copies."""
    rng = random.Random(5)
    base, shared, rows = prose(rng, 150, 5000).split(" "), prose(rng, 40, 5000), []
    for i in range(220):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            k = rng.randrange(len(w))
            if rng.random() < 0.5:
                w[k] = f"e{rng.randrange(400)}"
            else:
                del w[k]
        rows.append((i, " ".join(w)))
    for i in range(120):
        rows.append((1000 + i, shared + " " + prose(rng, rng.randrange(4, 60), 5000)))
    for i in range(40):
        w = rows[i][1].split(" ")
        w[rng.randrange(len(w))] = "again"
        rows.append((2000 + i, " ".join(w)))
    got = jaccard_join.jaccard_join(documents(spark, rows, repeat=False)).select("doc_id", "n_shingles", "component_id").collect()
    want = jaccard_classes(rows)
    assert 5 < len({c for _, _, c in want}) < len(rows)
    same_rows(got, want)


def test_jaccard_without_documents(spark):
    assert jaccard_join.jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0


def removed(rows):
    own = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            own[k] = min(own.get(k, float("inf")), float("inf") if d is None else d)
    out = []
    for d, t in rows:
        w, gone = WORD.findall(t or ""), set()
        for i in range(len(w) - 12):
            if own[tuple(w[i : i + 13])] < (float("inf") if d is None else d):
                gone.update(range(i, i + 13))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("seed", [0, 2])
def test_substring_dedup(spark, seed):
    rows = texts(seed)
    rows += [rows[0], (None, rows[4][1]), (None, None)]
    got = substring_dedup.substring_dedup(documents(spark, rows, repeat=False)).collect()
    same_rows([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got], removed(rows))
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)


def thue_morse(n):
    """Two texts of 2**n letters that collide under every polynomial modulo 2**64 with an odd base, for n > 10."""
    bits = [bin(i).count("1") % 2 for i in range(1 << n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("n", [7, 10, 13])
def test_words_that_polynomials_confuse(spark, n):
    a, b = thue_morse(n)
    tail = " ".join(f"w{i}" for i in range(12))
    rows = [(1, a), (2, b), (3, f"{a} {tail}"), (4, f"{b} {tail}"), (5, f"{a} {tail}")]
    docs = documents(spark, rows, repeat=False)
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_join(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 13}
    items = spark.createDataFrame([(1, a), (2, f"{b} {tail}")], "item_id long, text string")
    found = {r["doc_id"]: r["items"] or [] for r in decontamination.find_contamination(docs, items).collect()}
    assert found == {1: ["1"], 2: [], 3: ["1"], 4: ["2"], 5: ["1"]}
    twice = documents(spark, [(1, f"{a}\n{b}\n{a}")], repeat=False)
    assert quality_rules.quality_rules(twice, labels(spark)).first()["n_dup_lines"] == 1


def test_window_hashes_follow_the_words():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 3, 400).astype(np.uint64)
    for m in range(1, 15):
        got = K.window_hashes(h, m)
        want = [tuple(h[i : i + m]) for i in range(len(h) - m + 1)]
        assert len(got) == len(want) and len(set(got.tolist())) == len(set(want)) == len(set(zip(got.tolist(), want)))


def test_windows_alike_in_half_of_their_hash():
    h, again, owner = np.array([5, 5, 5, 7], np.uint64), np.array([1, 2, 1, 1], np.uint64), np.array([30, 20, 10, 10])
    _, again, owner, at = substring_dedup._in_order(h, again, owner)
    assert at.tolist() == [0, 2, 3, 4] and owner.tolist() == [10, 30, 20, 10] and again.tolist() == [1, 1, 2, 1]


def test_difference_cover():
    for a in range(7):
        for b in range(7):
            assert any((a + s) % 7 in substring_dedup.COVER and (b + s) % 7 in substring_dedup.COVER for s in range(7))
    assert substring_dedup.GRAM == 7


def test_substring_dedup_without_documents(spark):
    assert substring_dedup.substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fm_index_against_scanning():
    rng = np.random.default_rng(0)
    runs = [rng.integers(1, 5, rng.integers(1, 40)) for _ in range(30)] + [np.ones(50, int)] * 3
    text = np.concatenate([np.append(0, r) for r in runs] + [[0]]).astype(np.int64)
    index = fm_index.FMIndex(text, 5)
    for n in (1, 2, 3, 6):
        patterns = rng.integers(1, 5, (50, n))
        lo, hi = index.search(patterns.ravel(), np.arange(50) * n, n)
        for p, a, b in zip(patterns, lo, hi, strict=True):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


BENCH = [(1, " ".join(f"W{i}" for i in range(100, 130))), (2, "tiny item"), (3, None), (4, ""), (10, " ".join(f"w{i}" for i in range(105, 140))), (2, "other small one"), (None, "w1")]


def planted():
    rng = random.Random(4)
    rows = [(i, prose(rng, 120)) for i in range(30)]
    rows[3] = (3, prose(rng, 10) + " " + " ".join(f"w{i}" for i in range(100, 118)) + "! " + prose(rng, 20))
    rows[4] = (4, prose(rng, 300) + " (Tiny   ITEM) " + prose(rng, 300))
    rows[5] = (5, " ".join(f"w{i}" for i in range(104, 140)))
    return rows + [(40, None), (41, ""), (42, "tiny-item tiny item"), (5, rows[5][1]), (None, "tiny item")]


def contaminated(rows):
    windows = {}
    for i, t in BENCH:
        w = ALNUM.findall((t or "").translate(LOWER))
        if i is not None:
            for k in range(max(1, len(w) - 12) if w else 0):
                windows.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    out = []
    for d, t in rows:
        w, hit, items = ALNUM.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= own
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [1 << 18, 5])
def test_decontamination_in_one_block_and_in_many(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    rows = planted() + [(50, prose(random.Random(9), 60_000))]
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = decontamination.judged(decontamination.find_contamination(documents(spark, rows, repeat=False), bench))
    same_rows(got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect(), contaminated(rows))


def test_the_index_holds_every_word():
    w = K.words_of(pa.array([t for _, t in planted()], pa.string()), K.ALNUM, lower=True)
    shard = decontamination.Shard(w)
    assert int(shard.index.count[-1] - shard.index.count[1]) == w.n == sum(len(ALNUM.findall((t or "").translate(LOWER))) for _, t in planted())


def test_decontamination_without_items_or_documents(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert decontamination.find_contamination(spark.createDataFrame([], SCHEMA), bench).count() == 0
    assert decontamination.judged(decontamination.find_contamination(documents(spark), bench.limit(0))).where("n_hit > 0").count() == 0


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    odd = [(2000, "a  b   c\n \n d "), (2001, " lead"), (2002, "trail \n"), (2003, "it's 42  x <|endoftext|> y"), (2004, "tab\t x\r\n y  "), (2005, "'s 're  ' s"), (2006, " "), (2007, "  x")]
    rows = ROWS + odd
    manifest = token_output.write_tokens(documents(spark, rows, repeat=True), scratch(spark, "tokens"))
    got = sorted(map(tuple, token_output.read_tokens(manifest).collect()), key=lambda r: r[1])
    t = Tokenizer.from_file(token_output.tokenizer_path())
    plain = sorted(rows + [rows[0], (None, rows[4][1]), (None, None)], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, every = 0, []
    for g, (d, x) in zip(got, plain, strict=True):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert g == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        every += ids
    flat, masks = [], 0
    for r in manifest.orderBy("shard").collect():
        shard = token_output.Shard(r["tokens_path"], r["docs_path"])
        n = shard.tokens.num_rows
        for i in range(n):
            ids, mask = shard.sequence(i)
            flat += ids[mask].tolist()
            masks += int(mask.sum())
    assert flat == every and masks == len(every)
    # no copy: a sequence is a view of the mapped file
    ids, _ = shard.sequence(0)
    assert not ids.flags.owndata


def test_pieces_only_for_tokenizers_that_cut_at_spaces(spark, tmp_path):
    import json

    from tokenizers import Tokenizer

    path = token_output.tokenizer_path()
    assert token_output.Encoder(path).pieces
    described = json.loads(Tokenizer.from_file(path).to_str())
    described["normalizer"] = {"type": "Lowercase"}
    other = tmp_path / "lower.json"
    other.write_text(json.dumps(described))
    encoder = token_output.Encoder(str(other))
    assert not encoder.pieces
    for x in ("Some WORDS here", "A <|endoftext|> B"):
        assert encoder.encode(x) == np.array(Tokenizer.from_file(str(other)).encode(x, add_special_tokens=False).ids, encoder.kind).tobytes()


def test_what_failed_attempts_left_goes(spark):
    where = scratch(spark, "tokens")
    fs, at = token_output.open_uri(where)
    fs.create_dir(at, recursive=True)
    fs.open_output_stream(f"{at}/000000-lost.tokens.arrows").close()
    manifest = token_output.write_tokens(documents(spark), where).collect()
    left = {x.base_name for x in fs.get_file_info(token_output.FileSelector(at))}
    assert left == {r[k].rsplit("/", 1)[1] for r in manifest for k in ("tokens_path", "docs_path")}


def test_no_token_files_without_documents(spark):
    m = token_output.write_tokens(spark.createDataFrame([], SCHEMA), scratch(spark, "tokens"))
    assert m.count() == 0 and token_output.read_tokens(m).count() == 0
