"""Operators on whole texts against plain versions, over odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash

from opporta.llm import context_tree, decontaminate, language, lines, mixing, simhash, suffixes, token_files
from tests.llm.conftest import ODD, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_extra_columns_and_rows_stay(odd):
    benchmark = odd.selectExpr("doc_id AS item_id", "substring(text, 1, 90) AS text").where("doc_id = 8")
    for out, _ in (decontaminate.scan(odd, benchmark), language.predict(odd, language.learn(odd)), suffixes.deduplicated(odd)):
        assert set(odd.columns) <= set(out.columns)
        assert rows_of(out, *odd.columns) == rows_of(odd, *odd.columns)


def test_empty_tables(no_rows):
    benchmark = no_rows.selectExpr("doc_id AS item_id", "text")
    for out in (decontaminate.report(no_rows, benchmark), language.report(no_rows), lines.report(no_rows), simhash.report(no_rows), simhash.one_of_each(no_rows), mixing.report(no_rows),
                mixing.sample(no_rows), token_files.report(no_rows), suffixes.report(no_rows), context_tree.report(no_rows), language.known(no_rows), decontaminate.clean(no_rows, benchmark)):
        assert out.collect() == []


def test_decontamination_matches_plain_windows(spark, odd):
    items = [("q1", prose(300, 1)[:200]), ("q2", "Short TEXT"), ("q3", None), ("q4", "!!"), (None, "日本語 x"), ("q1", prose(6000, 8)[500:700]), ("q5", "short text"), ("q5", "short text")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def plain(text):
        w, hit, found = word.findall(low(text)), set(), set()
        for item, t in items:
            iw = word.findall(low(t))
            n = min(10, len(iw))
            for win in {tuple(iw[k:k + n]) for k in range(len(iw) - n + 1)} if n else ():
                for k in range(len(w) - n + 1):
                    if tuple(w[k:k + n]) == win:
                        hit.update(range(k, k + n))
                        found.add(item or "")
        return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)
    want = sorted(((i, *plain(t)) for i, t, *_ in ODD), key=repr)
    assert rows_of(decontaminate.report(odd, benchmark), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    out, name = decontaminate.scan(odd, benchmark, shard_bytes=300)  # several automata, the same answers
    assert rows_of(out, "doc_id", f"{name}.n_words", f"{name}.n_hit") == sorted(((r[0], r[1], r[2]) for r in want), key=repr)
    for r in out.selectExpr("text", f"{name}.spans").collect():
        for s in r.spans:
            assert word.fullmatch(r.text[s.start]) and word.fullmatch(r.text[s.end - 1])
    assert {r.doc_id for r in decontaminate.clean(odd, benchmark).collect()} == {i for i, *rest in want if not rest[-1]}


def test_lines_match_plain_units(odd):
    seen, want = set(), {}
    for i, t, *_ in sorted(set(ODD), key=lambda r: (r[0] is None, r[0] or 0)):
        kept, at, n = [], 0, 0
        for m in re.finditer(r"[^\n.?]+[.?!]*", t or ""):
            key = " ".join(m.group().lower().split())
            if key.count(" ") >= 7:
                if key in seen:
                    kept.append(t[at:m.start()])
                    at, n = m.end(), n + 1
                seen.add(key)
        want[(i, t)] = n, hashlib.sha256(("".join(kept) + (t or "")[at:]).encode()).hexdigest()
    got = lines.report(odd, "sentences")
    assert rows_of(got, "doc_id", "n_removed", "kept_sha256") == sorted(((i, *want[(i, t)]) for i, t, *_ in ODD), key=repr)


def plain_units(text):
    """Every unit of a text by its definition, quadratically: lines, shortest runs of sentences, runs between chosen words."""
    found, at = set(), 0
    for line in text.split("\n"):
        if line.split():
            found.add((at, at + len(line), " ".join(line.lower().split())))
        parts = [m for m in re.finditer(r"[^\n.?]+[.?!]*", line) if m.group().split()]
        size = [len(m.group().split()) for m in parts]
        whole = len(line.split()) > lines.LEAST_WORDS
        for i in range(len(parts)):
            for j in range(i + 1, len(parts) + 1):
                long = sum(size[i:j]) >= lines.LEAST_WORDS
                if whole and long and (sum(size[i:j - 1]) < lines.LEAST_WORDS or sum(size[i + 1:j]) < lines.LEAST_WORDS):
                    norm = " ".join(" ".join(m.group().lower().split()) for m in parts[i:j])
                    if norm != " ".join(line.lower().split()):
                        found.add((at + parts[i].start(), at + parts[j - 1].end(), norm))
        at += len(line) + 1
    spans, words = [m.span() for m in re.finditer(r"\S+", text)], text.lower().split()
    if len(words) < lines.GRAM + lines.REACH:
        return found

    def place_hash(p):
        h = sum(xxhash.xxh3_64_intdigest(words[p + k]) * pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(lines.GRAM)) % 2**64
        return (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64
    grams = [place_hash(p) for p in range(len(words) - lines.GRAM + 1)]
    least = sorted({min(range(p, p + lines.REACH), key=lambda q: (grams[q], q)) for p in range(len(grams) - lines.REACH + 1)})
    chosen = []
    for p in least:
        if not chosen or p - chosen[-1] >= lines.REACH or grams[p] != grams[chosen[-1]]:
            chosen.append(p)
    for a, z in zip(chosen, chosen[1:]):  # noqa: B905
        found.add((spans[a][0], spans[z + lines.GRAM - 1][1], "\n" + " ".join(words[a:z + lines.GRAM])))
    return found


def test_all_units_of_given_documents_match_a_plain_version(spark, odd):
    """Units by definition, the earliest kept, the rest removed: whole texts of both tables."""
    for docs in (odd, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        keyed = {(i, t): F_xxhash(spark, t) for i, t in rows if t is not None}
        first, own = {}, {}
        for (i, t), th in keyed.items():
            own[i, t] = plain_units(t)
            for a, _, u in own[i, t]:
                place = (i is None, i or 0, th, a)
                first[u] = min(first.get(u, place), place)
        want = []
        for i, t in rows:
            gone = np.zeros(len(t or ""), dtype=bool)
            for a, z, u in own.get((i, t), ()):
                if first[u] != (i is None, i or 0, keyed[i, t], a):
                    gone[a:z] = True
            want.append((i, int(gone.sum()), hashlib.sha256("".join(c for c, g in zip(t or "", gone, strict=True) if not g).encode()).hexdigest()))
        assert rows_of(lines.report(docs), "doc_id", "n_removed_chars", "kept_sha256") == sorted(want, key=repr)


def F_xxhash(spark, text):
    """Spark's hash of a text, which orders texts of one id."""
    return spark.sql("SELECT xxhash64(:t)", {"t": text}).first()[0]


def test_whole_lines_alone(odd):
    seen, want = set(), {}
    for i, t, *_ in sorted(set(ODD), key=lambda r: (r[0] is None, r[0] or 0)):
        gone = 0
        for line in (t or "").split("\n"):
            key = " ".join(line.lower().split())
            gone += bool(key) and key in seen
            seen.add(key)
        want[(i, t)] = gone
    assert rows_of(lines.report(odd, "lines"), "doc_id", "n_removed") == sorted(((i, want[(i, t)]) for i, t, *_ in ODD), key=repr)


def test_whole_lines_leave_no_short_repeat(spark):
    short = "He went. She stayed. Rain fell. Who knew? Nobody did. Dr. No paid 3.50 there."
    texts = ["Read more\n" + short, "  read   MORE\nOther words come first here. " + short + " And others follow it then.", "Read more", "An only line, with a tail of blanks and eight words.  ",
             "One. Two. Three. Four. Five. Six. Seven. Eight. Nine. Ten.", "Zero. Five. Six. Seven. Eight. Nine. Ten. Last."]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(2, "Read more"), (9, None), (10, "")], "doc_id bigint, text string")
    out, spans, left = lines.deduplicated(docs)
    got = {r.doc_id: r[left] for r in out.collect()}
    assert got == {0: texts[0], 1: "\nOther words come first here. And others follow it then.", 2: "", 3: texts[3], 4: texts[4], 5: texts[5], 9: None, 10: ""}
    assert {r.doc_id: r.n_removed for r in lines.report(docs).collect()} == {0: 0, 1: 2, 2: 1, 3: 0, 4: 0, 5: 0, 9: 0, 10: 0}


def test_every_repeated_run_of_sentences_is_covered():
    draw = np.random.default_rng(4)
    for _ in range(300):
        piece = lambda n: " ".join(" ".join(f"w{draw.integers(10**9)}" for _ in range(draw.integers(1, 7))) + "." for _ in range(n))
        passage = piece(draw.integers(1, 9))
        if len(passage.split()) < 8:
            continue
        a, b = (f"{piece(draw.integers(1, 4))} {passage} {piece(draw.integers(1, 4))}" for _ in range(2))
        seen = {u for _, _, u in lines.runs(a)}
        gone = np.zeros(len(b), dtype=bool)
        for start, end, u in lines.runs(b):
            if u in seen:
                gone[start:end] = True
        at = b.index(passage)
        assert gone[at:at + len(passage)].all() and gone.sum() == len(passage) + 1


def test_every_fifty_words_hold_a_passage():
    draw = np.random.default_rng(6)
    words = lambda n: " ".join(f"w{draw.integers(10**9)}" for _ in range(n))
    for _ in range(300):
        shared = words(50)
        a, b = ({u for *_, u in lines.passages(f"{words(draw.integers(30))} {shared}\n{words(draw.integers(30))}")} for _ in range(2))
        assert any(u.strip() in shared for u in a & b)
    assert len({u for *_, u in lines.passages("to " * 5000)}) == 1 and len(list(lines.passages("to " * 5000))) < 300


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffixes_match_plain_strings(odd, hot):
    count = collections.Counter(t.encode()[p:p + 400] for _, t, *_ in ODD if t for p in range(len(t.encode()) - 399))

    def plain(text):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 2, dtype=bool)
        for p in range(len(raw) - 399):
            if count[raw[p:p + 400]] > 1:
                gone[p + 1:p + 401] = True
        kept = bytes(b for b, g in zip(raw, gone[1:-1], strict=True) if not g)
        return len(raw), len(raw) - len(kept), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()
    out, name = suffixes.deduplicated(odd, hot=hot, batches=3)
    got = out.selectExpr("doc_id", f"{name}.n_bytes", f"{name}.n_removed", f"size({name}.spans) AS n", f"{name}.kept_sha256")
    assert rows_of(got, "*") == sorted(((i, *plain(t)) for i, t, *_ in ODD), key=repr)


def test_levels_grow_geometrically(spark, odd):
    found = suffixes.suffixes(odd.selectExpr("doc_id", "xxhash64(text) AS th", "text"))
    _, levels = suffixes.repeated(found, 7)
    assert sorted(levels.held) == [1, 2, 4]
    keys = {tuple(r) for level in levels.held.values() for r in level.collect()}
    assert keys == {(r.head, r.digest) for r in found.collect()}


def plain_print(text):
    w = WORD.findall(low(text))
    shingles = [" ".join(w[k:k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_matches_plain_components(odd):
    prints = [(i, plain_print(t)) for i, t, *_ in ODD]
    group = list(range(len(prints)))
    for _ in prints:
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    least = {g: min((i for (i, _), x in zip(prints, group, strict=True) if x == g and i is not None), default=None) for g in group}
    want = sorted(((i, f"{p:016x}", least[g]) for (i, p), g in zip(prints, group, strict=True)), key=repr)
    assert rows_of(simhash.report(odd), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(x for x in set(least.values()) if x is not None)
    assert kept.count() == len(set(group))


def test_vantage_trees_lose_no_pair(spark):
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 40, dtype=np.uint64)
    near = np.concatenate([base] + [base ^ np.bitwise_or.reduce([np.uint64(1) << draw.integers(0, 64, 40).astype(np.uint64) for _ in range(k)]) for k in (1, 2, 3, 4, 5)])
    fps = np.unique(np.concatenate([near, draw.integers(0, 2**63, 2000, dtype=np.uint64)]))
    frame = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    found = simhash.links(frame, leaf_rows=20, sample=500).collect()
    label = {int(x): int(x) for x in fps.view(np.int64)}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for r in found:
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4 or root(r.a) is not None
        a, b = root(r.a), root(r.b)
        label[max(a, b)] = min(a, b)
    for i, x in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(x ^ fps[i + 1:]) <= 4):
            assert root(int(x.astype(np.int64))) == root(int(fps[i + 1 + j].astype(np.int64)))


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.99 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_of_odd_rows(odd):
    got = {r.doc_id: r for r in language.report(odd).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} >= {4, 5, 6, 9}
    assert got[8].lang_pred == "en" and got[4].score == 0
    assert {i for i, r in got.items() if r.held_out} == {i for i, *_ in ODD if i is None or zlib.crc32(str(i).encode()) % 3 == 1}
    assert {r.doc_id for r in language.known(odd).collect()} == {i for i, t, *_ in ODD if t and any(c.isalpha() for c in t)}


def test_letter_vectors_are_nearly_orthogonal():
    assert abs(int(language.letter_vector(97).astype(int) @ language.letter_vector(98).astype(int))) < 200


def test_context_tree_scores(odd):
    tokens = {(i, t): WORD.findall(low(t)) + [None] for i, t, *_ in ODD}
    count = collections.Counter(w for i, t, *_ in ODD if i is not None and zlib.crc32(str(i).encode()) % 10 for w in tokens[(i, t)])
    n, v = sum(count.values()), len(count)
    want = sorted(((i, len(tokens[(i, t)]), sum(count[w] > 0 for w in tokens[(i, t)]), n,
                    round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[(i, t)]), 6)) for i, t, *_ in ODD), key=repr)
    got = context_tree.report(odd)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.collect()), key=repr) == want


def plain_tree(strings, depth):
    """Mixed probability of each string's last byte, by the definition, over (context, byte) counts."""
    node = collections.defaultdict(lambda: [0, 0])
    below = collections.defaultdict(set)
    for (context, byte), k in strings.items():
        for j in range(8):
            decision, bit = 1 << j | byte >> 8 - j, byte >> 7 - j & 1
            for d in range(depth + 1):
                node[(context[depth - d:], decision)][bit] += k
                if d < depth:
                    below[(context[depth - d:], decision)].add((context[depth - d - 1:], decision))
    kt = lambda a, b: math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(key):
        if key not in memo:
            own = kt(*node[key])
            memo[key] = own if len(key[0]) == depth else math.log(.5 * math.exp(own) + .5 * math.exp(sum(map(weighted, below[key]))))
        return memo[key]

    def chance(context, byte):
        total = 0.0
        for j in range(8):
            decision, bit = 1 << j | byte >> 8 - j, byte >> 7 - j & 1
            p = None
            for d in range(depth, -1, -1):
                key = context[depth - d:], decision
                own = (node[key][bit] + .5) / (sum(node[key]) + 1)
                stop = math.exp(kt(*node[key]) - weighted(key)) / 2
                p = own if p is None else stop * own + (1 - stop) * p
            total += math.log10(p)
        return total
    return chance


def test_context_tree_follows_the_definition(spark):
    texts = [b"abracadabra", b"abra cad", b"", b"bad"]
    keys, _ = context_tree.strings(texts, 3)
    table = collections.Counter(keys.tolist())
    table[int(context_tree.strings([b"zz"], 3)[0][0])] = 0  # a string that training does not have
    frame = spark.createDataFrame(list(table.items()), "key bigint, n bigint")
    parts = lambda key: (tuple(key >> 8 * k & 255 for k in (3, 2, 1)), key & 255)
    chance = plain_tree({parts(k): n for k, n in table.items()}, 3)
    for r in context_tree.model(frame, 3).collect():
        assert math.isclose(r.logp, chance(*parts(r.key)), rel_tol=1e-9), parts(r.key)


def test_context_tree_probabilities_sum_to_one(spark):
    seen = context_tree.strings([b"banana band", b"nab"], 5)[0].tolist()
    context = seen[4] >> 8
    every = collections.Counter({context << 8 | b: 0 for b in range(256)})
    every.update(seen)
    found = context_tree.model(spark.createDataFrame(list(every.items()), "key bigint, n bigint")).collect()
    assert math.isclose(sum(10 ** r.logp for r in found if r.key >> 8 == context), 1, rel_tol=1e-9)


def test_scores_in_several_passes_are_the_same(odd, monkeypatch):
    held = odd["doc_id"] == 8
    whole = {(r.doc_id, round(r.s.base, 6), round(r.s.score, 6), r.s.n_known, r.s.n_tokens) for r in (lambda o: o[0].withColumnRenamed(o[1], "s"))(context_tree.scores(odd.where("text IS NOT NULL"), ~held)).collect()}
    monkeypatch.setattr(context_tree, "TABLE_ROWS", 500)
    parts = {(r.doc_id, round(r.s.base, 6), round(r.s.score, 6), r.s.n_known, r.s.n_tokens) for r in (lambda o: o[0].withColumnRenamed(o[1], "s"))(context_tree.scores(odd.where("text IS NOT NULL"), ~held)).collect()}
    assert whole == parts
