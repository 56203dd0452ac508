"""Each stage of the pipeline against a plain version of it, over odd rows."""

import collections
import os
import re

import numpy as np
import public_tokenizers

import corpus_pipeline
from opporta.llm import common, mixing, near_copies, simhash, token_files
from tests.llm.conftest import prose
from tests.llm.test_text_operators import low, plain_print

SIZE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_stages_match_plain_versions(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    leak = prose(6000, 8)[3000:3300]
    spark.createDataFrame([(1, leak), (2, "words that are in no document whatsoever and so on and on")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frames = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        frames[name] = common.stored(stage(spark, [*frames.values()][-1], str(tmp_path)), name)
    rows = {name: [tuple(r) for r in frame.collect()] for name, frame in frames.items()}
    # language: texts with a letter
    lettered = [r for r in rows[""] if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted(map(repr, rows["language_id"])) == sorted(map(repr, lettered))
    # near copies: groups by links of at least 0.8 of five-word shingles, one row with the smallest id of each
    sets, group = [set(near_copies.shingles(r[1]).tolist()) for r in lettered], list(range(len(lettered)))
    for _ in lettered:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x == y or len(x & y) >= 0.8 * len(x | y):
                    group[a] = group[b] = min(group[a], group[b])
    members = collections.defaultdict(list)
    for g, r in zip(group, lettered, strict=True):
        members[g].append(r)
    least = {g: min((r[0] for r in own if r[0] is not None), default=None) for g, own in members.items()}
    assert sorted((r[0] for r in rows["near_dedup"]), key=repr) == sorted(least.values(), key=repr)
    assert all(r in lettered for r in rows["near_dedup"])
    # benchmark passages: any ten words in a row
    item = WORD.findall(low(leak))
    windows = {tuple(item[k:k + 10]) for k in range(len(item) - 9)}

    def leaks(text):
        w = WORD.findall(low(text))
        return any(tuple(w[k:k + 10]) in windows for k in range(len(w) - 9))
    assert sorted(map(repr, rows["decontamination"])) == sorted(repr(r) for r in rows["near_dedup"] if not leaks(r[1]))
    assert any(leaks(r[1]) for r in rows["near_dedup"])
    # mix: source totals near their targets, no document more than three times, texts made of the documents' words in order
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows["decontamination"]:
        sizes[r[3]] += len(SIZE.findall(r[1]))
    for r in rows["mix"]:
        taken[r[3]] += len(SIZE.findall(r[1]))
        own = [d for d in rows["decontamination"] if d[0] == r[0] and d[3] == r[3]]
        it = iter(SIZE.findall(own[0][1]))
        assert r[4] == len(r[1]) and all(w in it for w in SIZE.findall(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for source, target in zip(order, mixing.targets([sizes[s] for s in order]), strict=True):
        assert abs(taken[source] - target) <= 2 * mixing.BLOCK_WORDS and taken[source] <= 3 * sizes[source]
    # token files: an exact round trip of the mix
    want = token_files.brute([(r[0], r[1]) for r in rows["mix"]], public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(((r[0], r[2], r[3]) for r in rows["token_output"]), key=repr) == sorted(((r[0], r[2], r[3]) for r in want), key=repr)
    assert sum(r[2] for r in rows["token_output"]) == max(r[1] + r[2] for r in rows["token_output"])


def test_near_copies_of_odd_rows(spark, odd, no_rows):
    """Null, wordless, repeated and very long texts, null ids, columns named like those used inside."""
    kept = near_copies.one_of_each(odd.withColumnRenamed("fp", "shingle_set").withColumnRenamed("language", "node"))
    assert kept.columns == [c.replace("language", "node") if c == "language" else "shingle_set" if c == "fp" else c for c in odd.columns]
    rows = kept.collect()
    want = {}
    for r in odd.collect():
        own = tuple(near_copies.shingles(r.text or "").tolist())
        near = next((k for k in want if own == k or own and k and len(set(own) & set(k)) >= 0.8 * len(set(own) | set(k))), own)
        want[near] = min(want.get(near, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted(want.values())
    assert near_copies.one_of_each(no_rows).count() == 0


def test_a_bucket_in_pieces_gives_the_same_links(spark, monkeypatch):
    """Many texts on one template, below 0.8, with some near copies among them."""
    base = [f"t{k}" for k in range(150)]
    rows = [(k, " ".join(base[:100] + [f"own{k}x{j}" for j in range(50)])) for k in range(120)]
    rows += [(1000 + k, rows[k][1].replace(f"own{k}x25 ", "")) for k in range(0, 120, 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = list(range(120))
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == want
    monkeypatch.setattr(near_copies, "PIECE", 7)
    made, name = near_copies.with_node(docs)
    rows_ = common.stored(made.select("text", f"{name}.*"), "test-nodes")
    heads = rows_.drop("text")
    root = common.components(near_copies.links(heads, near_copies.shared_buckets(heads), near_copies._sets(rows_), rounds=0))
    assert root.select("root").distinct().count() == 12 and root.count() == 24


def test_near_copies_of_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets, group, holds = [set(near_copies.shingles(t or "").tolist()) for _, t in rows], list(range(len(rows))), collections.defaultdict(list)

    def root(k):
        while group[k] != k:
            k = group[k]
        return k
    for k, own in enumerate(sets):  # every pair with a common shingle, by brute force
        both = collections.Counter(j for s in own for j in holds[s])
        for j, n in both.items():
            if n >= 0.8 * (len(own) + len(sets[j]) - n):
                a, b = root(j), root(k)
                group[max(a, b)] = min(a, b)
        for s in own:
            holds[s].append(k)
    wordless = [k for k, own in enumerate(sets) if not own]
    want = sorted(rows[k][0] for k in range(len(rows)) if root(k) == k and k not in wordless[1:])
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()) == want


def test_an_edited_copy_goes_whatever_its_bits(spark):
    words = [f"w{k}" for k in range(400)]
    edited = [f"x{k}" if k % 60 == 30 else w for k, w in enumerate(words)]
    far = [f"x{k}" if k % 30 == 15 else w for k, w in enumerate(words)]
    a, b, c = (set(near_copies.shingles(" ".join(w)).tolist()) for w in (words, edited, far))
    assert len(a & b) >= 0.8 * len(a | b) and len(a & c) < 0.8 * len(a | c) and np.bitwise_count(np.uint64(plain_print(" ".join(words)) ^ plain_print(" ".join(edited)))) > 4
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate((words, edited, far))], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()) == [0, 2]


def test_fingerprints_alone_find_what_is_within_their_radius(spark, monkeypatch):
    """Without any bucket of min-hashes, copies at most four bits apart are found by their SimHash, and those further apart are not."""
    rng = np.random.Generator(np.random.Philox(key=3))
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5_000, 400)) for _ in range(40)]
    rows = [*enumerate(texts), *((100 + k, t + " end") for k, t in enumerate(texts)), (200, " ".join(f"x{k}" if k % 60 == 30 else w for k, w in enumerate(texts[0].split())))]
    prints = {k: simhash.folded(near_copies.shingles(t)) & (1 << 64) - 1 for k, t in rows}
    near = {k: [j for j in range(40) if (prints[k] ^ prints[j]).bit_count() <= simhash.RADIUS] for k, _ in rows if k >= 100}
    assert all(near[100 + k] in ([k], []) for k in range(40)) and sum(map(len, near.values())) > 30 and near[200] == []
    real = near_copies.shared_buckets
    monkeypatch.setattr(near_copies, "shared_buckets", lambda heads: common.stored(real(heads).where("node is null"), "no-buckets"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted(r.doc_id for r in near_copies.one_of_each(docs).collect())
    assert got == [*range(40), *(k for k in sorted(near) if not near[k])]


def test_texts_just_below_the_similarity_are_not_compared_pair_by_pair(spark, monkeypatch):
    """A cloud of texts at some 0.74 of each other, a few of them edited: sets move for the edited ones, not for all pairs."""
    rng = np.random.Generator(np.random.Philox(key=5))
    base, rows = [f"t{k}" for k in range(300)], []
    for k in range(150):
        own = list(base)
        for at in rng.choice(60, 5, replace=False):
            own[at * 5] = f"own{k}x{at}"
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, rows[k][1] + " and one more") for k in range(0, 150, 15)]
    sets = {k: set(near_copies.shingles(t).tolist()) for k, t in rows}
    alike = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    made, name = near_copies.with_node(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))
    nodes = common.stored(made.select("doc_id", "text", f"{name}.*"), "test-nodes")
    number, moved, confirmed = {r.node: r.doc_id for r in nodes.select("node", "doc_id").collect()}, [], near_copies.confirmed

    def counted(pairs, *rest):
        moved.append(pairs.count())
        return confirmed(pairs, *rest)
    monkeypatch.setattr(near_copies, "confirmed", counted)
    heads = nodes.drop("doc_id", "text")
    found = near_copies.links(heads, near_copies.shared_buckets(heads), near_copies._sets(nodes), rounds=0)
    group = {k: k for k in sets}
    for _ in sets:
        for a, b in alike:
            group[a] = group[b] = min(group[a], group[b])
    got = {number[r.node]: r.root for r in common.components(found).collect()}
    want = {k for pair in alike for k in pair}
    assert set(got) == want and len(set(got.values())) == len({group[k] for k in want})
    assert sum(moved) < 3 * len(rows) + 2 * len(alike)


def test_odd_sketches_never_differ_more_than_the_sets():
    rng = np.random.Generator(np.random.Philox(key=9))
    for size in (1, 60, 127, 128, 700, 9_000):
        whole = np.unique(rng.integers(0, 2**32, 2 * size, dtype=np.uint64).astype(np.uint32)).view(np.int32)
        for share in (0.1, 0.5, 0.9):
            x, y = whole[:max(1, int(len(whole) * share))], whole[len(whole) // 4:]
            if len(y):
                a, b = near_copies._narrowed([near_copies.sketch(x), near_copies.sketch(y)])
                assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))
                assert (near_copies._narrowed([near_copies.sketch(x)] * 2)[0] == near_copies._narrowed([near_copies.sketch(x)])[0]).all()


def test_stages_leave_only_the_steps_that_their_rows_are_read_from(spark, tmp_path):
    """A pipeline's disk is that of its largest stage, not of all stages; documents that lie in files are not written again."""
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    top, left = common.shared_folder(spark, "x").removeprefix("file:").rsplit("/", 1)[0], {}
    for name in ("near_dedup", "mix", "token_output"):
        before = set(os.listdir(top))
        rows = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
        left[name] = sorted(re.sub("-[0-9a-f]{32}$", "", x) for x in set(os.listdir(top)) - before if not re.fullmatch(r"rdd-\d+", x))
        assert rows.count() > 0
    assert left == {"near_dedup": ["near-kept"], "mix": ["mix-places"], "token_output": ["token-files"]}
