"""The operators against plain versions, on a small corpus with every odd case."""

import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from dwelltrace.llm import (
    bpe_codec,
    components,
    decision_list,
    exact_dedup,
    registry,
    repeated_spans,
    run_index,
    secret_scan,
    simhash,
    source_mix,
    text_stats,
    token_files,
    toxicity,
    weak_labels,
)
from dwelltrace.llm.common import join_by_key, lowest_hashes, scratch, staged
from dwelltrace.llm.pretokens import PieceTable

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def by_id(df, *columns):
    return {row[0]: tuple(row[1:]) for row in df.select("doc_id", *columns).collect()}


# -- op1 ---------------------------------------------------------------------------------


def test_label_model_finds_the_better_heuristics():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.7
    rates = [0.9, 0.8, 0.75, 0.55]  # how often each is right; the last hardly ever
    votes = np.stack([np.where(rng.random(len(good)) < r, np.where(good, 1, -1), np.where(good, -1, 1)) for r in rates], 1)
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, learned, prior = weak_labels.estimate(patterns, counts.astype(float))
    assert abs(prior - 0.7) < 0.05
    for j, rate in enumerate(rates):
        voted = learned[:, j, [0, 2]].sum(axis=1)
        assert abs(learned[1, j, 2] / voted[1] - rate) < 0.06
    right = ((posterior[where.reshape(-1)] > 0.5) == good).mean()
    assert right > ((votes.sum(axis=1) > 0) == good).mean()


def test_weak_quality(spark):
    rng = random.Random(1)
    from conftest import frame, prose

    clean = [(i, prose(rng, rng.randint(30, 200)), "s") for i in range(150)]
    junk = [(1000 + i, " ".join([w + "***"[: 1 + i % 3] for w in prose(rng, 90).split()]), "s") for i in range(20)]
    junk += [(2000 + i, " ".join([prose(rng, 1)] * 80), "s") for i in range(20)]
    junk += [(3000 + i, prose(rng, 80).upper().replace(" ", "!! "), "s") for i in range(20)]
    out = {r.doc_id: r for r in weak_labels.weak_quality(frame(spark, clean + junk)).collect()}
    assert sum(out[i].kept for i, _, _ in clean) >= 0.97 * len(clean)
    assert sum(not out[i].kept for i, _, _ in junk) >= 0.9 * len(junk)
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in out.values())


@pytest.mark.parametrize("name", ["documents", "no_ids"])
def test_weak_quality_of_odd_rows(request, name):
    docs = request.getfixturevalue(name)
    out = weak_labels.weak_quality(docs)
    assert out.columns == ["doc_id", "posterior", "score", "kept"]
    assert out.count() == docs.count()


# -- op2 ---------------------------------------------------------------------------------


def test_index_against_all_windows():
    rng = random.Random(2)
    for _ in range(150):
        base = bytes(rng.choice(b"ab") for _ in range(30))
        strings = []
        for _ in range(rng.randint(1, 8)):
            a = rng.randint(0, 20)
            strings.append(base[a : a + rng.randint(1, 25)] if rng.random() < 0.7 else bytes(rng.choices(b"abc", k=9)))
        text = np.frombuffer(b"".join(strings), np.uint8)
        sizes = np.array(list(map(len, strings)))
        ends = np.cumsum(sizes)
        starts, ends = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        for length in (1, 4):
            found: dict[bytes, list[int]] = {}
            for i in range(len(text)):
                if i + length <= ends[i]:
                    found.setdefault(text[i : i + length].tobytes(), []).append(i)
            places, leaders = run_index.repeated_windows(text, starts, ends, length)
            expected = {i: at[0] for at in found.values() if len(at) > 1 for i in at}
            assert dict(zip(places.tolist(), leaders.tolist())) == expected


def test_runs_compress_repetitive_text():
    string = bytes(random.Random(0).choices(b"abcd", k=400))
    text = np.frombuffer(string * 30, np.uint8)
    ends = np.full(len(text), len(text))
    index = run_index.build_index(text, np.zeros(len(text), int), ends)
    assert len(index.letters) < len(text) / 10
    assert index.lengths.sum() == len(text)


@pytest.mark.parametrize("length", [40, 100])
def test_repeated_spans(documents, texts, length):
    out = repeated_spans.remove_repeats(documents, length=length, block_bytes=20_000, bucket_bytes=5_000)
    got = {
        r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), brute.sha(bytes(r.kept)))
        for r in out.collect()
    }
    assert got == brute.repeats(texts, length)


def test_repeated_spans_with_hot_anchors(documents, texts, monkeypatch):
    # Anchors of the shared passage occur often enough to be cut. The setting reaches the workers
    # in the function that carries it.
    hot = repeated_spans._answer_hashes.__globals__
    monkeypatch.setitem(hot, "_HOT", 3)
    source = [repeated_spans._answer_hashes]

    def answer(batches):
        from dwelltrace.llm import repeated_spans as module

        module._HOT = 3
        yield from module._answer_hashes(batches)

    monkeypatch.setattr(repeated_spans, "_answer_hashes", answer)
    out = repeated_spans.remove_repeats(documents, block_bytes=20_000, bucket_bytes=5_000)
    assert source and {r.doc_id: brute.sha(bytes(r.kept)) for r in out.collect()} == {
        doc: row[3] for doc, row in brute.repeats(texts, 100).items()
    }


def test_repeated_spans_of_odd_rows(nothing, no_ids):
    assert repeated_spans.remove_repeats(nothing).count() == 0
    assert repeated_spans.remove_repeats(no_ids.coalesce(1)).count() == no_ids.count()


# -- op3 ---------------------------------------------------------------------------------


def test_token_files(spark, documents, texts):
    path = scratch(spark, "test-tokens")
    token_files.write_token_files(documents, path, JSON, pattern=public_tokenizers.PATTERN, added_tokens=True, shard_bytes=1_000)
    read = token_files.read_token_files(spark, path)
    got = by_id(read, "start", (F.length("ids") / 4).cast("int"), F.crc32("ids"))
    assert got == brute.token_file(texts)
    shards = spark.read.parquet(f"{path}/shards")
    assert shards.count() > 3 and shards.select("dictionary").distinct().count() == 1
    for doc in (1, 1000, 1015):
        (ids,) = token_files.read_document(spark, path, doc)
        assert len(ids) == got[doc][1] and ids[-1] == 2
    assert token_files.read_document(spark, path, 5) == []


def test_token_files_need_their_dictionary(spark, documents):
    path = scratch(spark, "test-tokens")
    token_files.write_token_files(documents, path, JSON)
    shards = spark.read.parquet(f"{path}/shards").withColumn("dictionary", F.lit("other"))
    other = scratch(spark, "test-tokens")
    shards.write.parquet(f"{other}/shards")
    spark.read.parquet(f"{path}/dictionary").write.parquet(f"{other}/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        token_files.read_token_files(spark, other).collect()


def test_a_dictionary_helps_short_documents():
    samples = [np.arange(k, k + 40, dtype="<u2").tobytes() * 2 for k in range(400)]
    dictionary = token_files._zstd_dictionary(token_files.train_dictionary(samples, 4096))
    import zstandard

    plain, trained = zstandard.ZstdCompressor(), zstandard.ZstdCompressor(dict_data=dictionary)
    assert sum(len(trained.compress(s)) for s in samples) < sum(len(plain.compress(s)) for s in samples)


def test_token_files_of_odd_rows(spark, nothing, no_ids):
    for docs in (nothing, no_ids):
        path = scratch(spark, "test-tokens")
        token_files.write_token_files(docs, path, JSON)
        rows = token_files.read_token_files(spark, path).orderBy("start").collect()
        assert len(rows) == docs.count()
        assert [r.start for r in rows] == [sum(len(x.ids) // 4 for x in rows[:i]) for i in range(len(rows))]


# -- op4 ---------------------------------------------------------------------------------


def test_statistics(documents, texts):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert by_id(text_stats.document_statistics(documents), *columns) == {d: brute.statistics(t) for d, t in texts.items()}


def test_rules_are_found_in_order_and_pruned():
    rng = np.random.default_rng(3)
    table = {name: rng.random(600) for name in decision_list.FEATURES}
    bad = (table["symbols_per_word"] > 0.7) | ((table["upper_share"] > 0.5) & (table["mean_word"] <= 0.3))
    rules = decision_list.learn_rules(table, bad)
    covered = np.logical_or.reduce([rule.covers(table) for rule in rules])
    assert (covered == bad).mean() > 0.97
    assert all(len(rule.conditions) <= 4 for rule in rules)
    assert decision_list.learn_rules(table, np.zeros(600, bool)) == []


@pytest.mark.parametrize("n, rows", [(50, 40), (50, 400), (200, 5000), (3, 5000)])
def test_lowest_hashes_are_those_of_a_whole_sort(spark, n, rows):
    df = spark.range(rows).select((F.col("id") % (rows // 2 + 1)).alias("k"), "id")
    expected = df.orderBy(F.xxhash64("k"), "k", "id").limit(n).collect()
    assert lowest_hashes(df, n, "k", "id").collect() == expected
    one = df.withColumn("k", F.lit(7))
    assert lowest_hashes(one, n, "k", "id").count() == min(n, rows)


def test_rows_of_hot_keys_stay_where_they_are(spark):
    rows = staged(spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id")).alias("k"), "id"), "t")
    table = staged(spark.range(-5, 40_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "t")
    met = join_by_key(rows, table, ["k"])
    assert sorted(met.collect()) == sorted(rows.join(table, "k").collect())
    largest = met.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 20_000
    assert join_by_key(rows.filter("k < 0"), table, ["k"]).count() == 0


def test_judged_quality(spark, documents, texts):
    labels = spark.createDataFrame([(d, int("***" not in t and len(t) > 20), 0) for d, t in texts.items()], "doc_id long, quality int, toxic int")
    out = by_id(decision_list.judge_quality(documents, labels), "n_words", "n_repeat_words", "base_failed", "rule", "kept")
    for n_words, n_repeat, failed, rule, kept in out.values():
        assert failed == (n_words < 50 or 100 * n_repeat > 50 * n_words)
        assert kept == (not failed and rule is None)
    assert set(out) == set(texts)


def test_judged_quality_without_labels_or_rows(spark, documents, nothing, no_ids):
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    out = decision_list.judge_quality(documents, labels)
    assert out.filter("kept = base_failed").count() == 0
    assert decision_list.judge_quality(nothing, labels).count() == 0
    assert decision_list.judge_quality(no_ids, labels).count() == no_ids.count()


# -- op5 ---------------------------------------------------------------------------------


def test_targets_are_capped_and_reshared():
    targets = source_mix.weighted_targets([100, 10, 10, 0], [1, 2, 3, 1], 3)
    assert targets == pytest.approx([60, 30, 30, 0])
    assert source_mix.weighted_targets([], [], 3) == []
    assert sum(source_mix.weighted_targets([5, 7, 11, 200], [1, 2, 3, 1], 3)) == pytest.approx(223)


@pytest.mark.parametrize("n", [1, 2, 3, 40, 700])
def test_flight_keeps_both_totals(n):
    rng = np.random.default_rng(n)
    sizes = rng.integers(0, 2000, n).tolist()
    p = rng.random(n).tolist()
    before = sum(p), sum(a * b for a, b in zip(p, sizes))
    source_mix.fly(p, sizes, rng, land=False)
    assert sum(0 < x < 1 for x in p) <= 6
    assert (sum(p), sum(a * b for a, b in zip(p, sizes))) == pytest.approx(before, abs=1e-4)
    p = rng.random(n).tolist()
    words = sum(a * b for a, b in zip(p, sizes))
    source_mix.fly(p, sizes, rng, land=True)
    assert all(x in (0, 1) for x in p)
    if n > 20:
        assert abs(sum(a * b for a, b in zip(p, sizes)) - words) < 10


def test_inclusion_is_as_probable_as_it_should_be():
    taken = np.zeros(60)
    for seed in range(600):
        p = [0.3] * 60
        source_mix.fly(p, list(range(10, 70)), np.random.default_rng(seed), land=False)
        taken += p
    assert abs(taken / 600 - 0.3).max() < 0.09


def test_mix(spark):
    rng = random.Random(4)
    from conftest import frame, prose

    sources = ["a"] * 300 + ["b"] * 80 + ["B"] * 80 + [None] * 40
    rows = [(i, prose(rng, rng.randint(1, 60)), s) for i, s in enumerate(sources)]
    docs = frame(spark, rows)
    out = source_mix.mix_sources(docs, block=64)  # several levels
    table = out.toPandas()
    for source, own in table.groupby("source", dropna=False):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) < 5
        assert own["size"].sum() == own["source_size"].iloc[0]
    assert (table["taken"] <= 3 * table["size"]).all()
    assert table.groupby("source", dropna=False)["target"].first().sum() == pytest.approx(table["size"].sum())
    again = source_mix.mix_sources(docs.repartition(7), block=64).toPandas()
    assert by_rows(table) == by_rows(again)
    copies = Counter(r.doc_id for r in source_mix.mixed_documents(docs, block=64).collect())
    assert copies == Counter({int(d): int(c) for d, c in zip(table["doc_id"], table["copies"]) if c})


def by_rows(table):
    return sorted(map(repr, table.astype(object).where(table.notna(), None).itertuples(index=False)))


def test_mix_of_odd_rows(documents, nothing, no_ids):
    assert source_mix.mix_sources(nothing).count() == 0
    assert source_mix.mixed_documents(nothing).count() == 0
    for docs in (documents, no_ids):
        out = source_mix.mix_sources(docs).toPandas()
        assert len(out) == docs.count() and (out["taken"] <= 3 * out["size"]).all()
        mixed = source_mix.mixed_documents(docs)
        assert mixed.columns == docs.columns and mixed.count() == out["copies"].sum()


# -- op6 ---------------------------------------------------------------------------------


def test_exact_groups(documents, rows):
    groups = brute.exact_groups([(d, t) for d, t, _ in rows])
    expected = {d: (min(ids), len(ids), d == min(ids), brute.sha(text)) for text, ids in groups.items() for d in ids}
    few = lambda text: F.pmod(F.xxhash64(text), F.lit(3))  # all chains are long
    crowded = lambda text: F.shiftleft(F.pmod(F.xxhash64(text), F.lit(20)), 40)
    for options in ({}, {"capacity": 2}, {"key": few}, {"capacity": 1, "key": crowded}):
        assert by_id(exact_dedup.exact_groups(documents, **options), "keep_id", "group_size", "kept", "text_sha256") == expected
    stays = exact_dedup.drop_exact_copies(documents)
    assert stays.columns == documents.columns
    assert sorted(r.doc_id for r in stays.collect()) == sorted(d for d, row in expected.items() if row[2])


def test_directory_doubles_where_keys_crowd():
    depth, slots = exact_dedup.grow_directory({0: 5, 1: 5, 2: 1, 9: 1}, 4, 5)
    assert depth == 4 and len(slots) == 16
    assert [slot for slot, _, _ in slots] == list(range(16))
    assert {(bucket, local) for _, bucket, local in slots} == {(0, 4), (1, 4), (2, 3), (4, 2), (8, 1)}
    assert exact_dedup.grow_directory({}, 4, 5) == (0, [(0, 0, 0)])
    assert exact_dedup.grow_directory({3: 100}, 2, 5)[0] == 2  # equal keys cannot be split


def test_the_index_holds_what_owners_decided(spark, documents, rows, tmp_path):
    path = str(tmp_path / "index")
    out = exact_dedup.exact_groups(documents, capacity=2, index_path=path, key=lambda text: F.pmod(F.length(text), F.lit(7)).cast("long"))
    groups = brute.exact_groups([(d, t) for d, t, _ in rows])
    assert out.count() == len(rows)
    index = spark.read.parquet(path)
    assert sorted((r.text_sha256, r.keep_id, r.group_size) for r in index.collect()) == sorted(
        (brute.sha(text), min(ids), len(ids)) for text, ids in groups.items()
    )
    chains = index.groupBy("bucket", "key").agg(F.sort_array(F.collect_list("link")).alias("links")).collect()
    assert all(r.links == list(range(1, len(r.links) + 1)) for r in chains) and max(len(r.links) for r in chains) > 3


def test_a_crowd_of_copies_does_not_meet(spark):
    texts = [(i if i % 3 else None, "the same text" if i % 2 else f"text {i % 400}") for i in range(6000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(13)
    out = exact_dedup.exact_groups(docs)
    groups = brute.exact_groups(texts)
    expected = Counter(
        (d, min((i for i in ids if i is not None), default=None), len(ids), brute.sha(t)) for t, ids in groups.items() for d in ids
    )
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out.collect()) == expected
    assert out.filter("kept").count() == len(groups)


def test_exact_groups_of_odd_rows(nothing, no_ids):
    assert exact_dedup.exact_groups(nothing).count() == 0
    assert exact_dedup.drop_exact_copies(nothing).count() == 0
    out = exact_dedup.exact_groups(no_ids).toPandas()
    assert len(out) == no_ids.count()
    assert out[out["kept"]].groupby("text_sha256").size().max() == 1
    texts = no_ids.select(exact_dedup.normalised().alias("t")).distinct().count()
    assert exact_dedup.drop_exact_copies(no_ids).count() == texts


# -- op7 ---------------------------------------------------------------------------------


def test_near_groups(documents, texts):
    prints = {d: brute.fingerprint(t) for d, t in texts.items()}
    expected = brute.components(prints)
    out = registry.QUERIES and by_id(
        simhash.near_groups(documents), F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id"
    )
    assert out == {d: (f"{prints[d]:016x}", expected[d]) for d in texts}
    stays = simhash.drop_near_copies(documents)
    assert stays.columns == documents.columns
    assert sorted(r.doc_id for r in stays.collect()) == sorted(set(expected.values()))


@pytest.mark.parametrize("radius", [0, 1, 4, 6])
def test_bit_slices(radius):
    rng = np.random.default_rng(radius)
    prints = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    flips = [np.uint64(1 << int(b)) for b in rng.integers(0, 64, 600)]
    near = np.array([prints[i % 200] ^ flips[i] ^ flips[(i * 7) % 600] ^ flips[(i * 3) % 600] for i in range(300)])
    lanes = np.concatenate([prints, near])
    rows, cols = simhash.close_lanes(prints, simhash.bit_planes(lanes), radius)
    got = {(a, b) for a, b in zip(rows.tolist(), cols.tolist()) if b < len(lanes)}
    distance = np.bitwise_count(prints[:, None] ^ lanes[None, :])
    assert got == set(map(tuple, np.argwhere(distance <= radius).tolist()))


@pytest.mark.parametrize("chunk", [4, 16_384])
def test_links_of_a_crowd(spark, chunk):
    """Hundreds of prints a few bits around a few centres: whole components, few links."""
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    prints = set()
    while len(prints) < 900:
        value = int(centres[rng.integers(5)])
        for b in rng.integers(0, 64, rng.integers(0, 4)):
            value ^= 1 << int(b)
        prints.add(value)
    values = {i: v for i, v in enumerate(sorted(prints))}
    rows = [(v - (1 << 64) if v >> 63 else v, i) for i, v in values.items()]
    classes = spark.createDataFrame(rows, "fp long, rep long")
    links = simhash.near_links(classes, chunk=chunk)
    found = {r.node: r.component for r in components.connected_components(links).collect()}
    assert {i: found.get(i, i) for i in values} == brute.components(values)
    if chunk > 900:
        assert links.count() < 15 * len(values)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = components.connected_components(spark.createDataFrame(chain, "a long, b long"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_near_groups_of_odd_rows(nothing, no_ids):
    assert simhash.near_groups(nothing).count() == 0
    assert simhash.drop_near_copies(nothing).count() == 0
    assert simhash.near_groups(no_ids).count() == no_ids.count()


# -- op8 ---------------------------------------------------------------------------------


def test_secrets(documents, texts):
    found = by_id(secret_scan.scan_secrets(documents), "found")
    for doc, (spans,) in found.items():
        base = [(s.start, s.place, s.kind, s.end) for s in spans if s.place < 3]
        assert base == brute.secrets(texts[doc])
    assert set(found) == set(texts)
    digest = by_id(secret_scan.secret_digest(secret_scan.scan_secrets(documents)), "n_assign", "base_sha256", "spans")
    for doc, (n, sha, _) in digest.items():
        expected = brute.secrets(texts[doc])
        assert n == sum(kind == "assign" for _, _, kind, _ in expected)
        assert sha == brute.sha(",".join(f"{kind}:{a}:{b}" for a, _, kind, b in expected))


def test_only_unseen_blobs_and_rules_are_scanned(spark, documents):
    from conftest import frame

    path = scratch(spark, "test-ledger")
    rules = secret_scan.BASE_RULES
    first = secret_scan.scan_secrets(documents, rules, ledger_path=path)
    blobs = documents.select(F.coalesce("text", F.lit(""))).distinct().count()
    first_rows = sorted(map(repr, first.collect()))
    assert secret_scan.read_ledger(spark, path).count() == blobs
    again = secret_scan.scan_secrets(documents, rules, ledger_path=path)
    assert sorted(map(repr, again.collect())) == first_rows
    assert secret_scan.read_ledger(spark, path).count() == blobs  # nothing was scanned
    # A new version of one text and a new rule: one blob for all rules, all blobs for one rule.
    more = frame(spark, [(1, "token: abcdefgh", "s0"), (2, "", "s0")])
    secret_scan.scan_secrets(more, rules, ledger_path=path)
    ledger = secret_scan.read_ledger(spark, path)
    assert ledger.count() == blobs + 1
    changed = (*rules[:2], secret_scan.SecretRule("hex", "[0-9a-f]{30,}", version="2"))
    third = secret_scan.scan_secrets(documents, changed, ledger_path=path)
    new = secret_scan.read_ledger(spark, path).filter(F.size("findings") == 1)
    assert new.count() == blobs and new.filter(F.map_contains_key("findings", "hex@2")).count() == blobs
    assert third.filter(F.exists("found", lambda s: (s["kind"] == "hex") & (s["end"] - s["start"] < 30))).count() == 0


def test_further_kinds(spark):
    from conftest import frame

    texts = [
        "-----BEGIN RSA PRIVATE KEY-----\nMIIabc+/=\n-----END",
        "see postgres://bob:s3cret@db.host/x",
        "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK",
        "ghp_" + "a1" * 20,
    ]
    out = secret_scan.scan_secrets(frame(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()
    kinds = {r.doc_id: {s.kind for s in r.found} for r in out}
    for i, kind in enumerate(["private_key", "url_password", "web_token", "service_token"]):
        assert kind in kinds[i]


def test_secrets_of_odd_rows(nothing, no_ids):
    assert secret_scan.scan_secrets(nothing).count() == 0
    assert secret_scan.scan_secrets(no_ids).count() == no_ids.count()


def test_native_operators_run_no_python(spark, documents):
    for df in (exact_dedup.exact_groups(documents), secret_scan.scan_secrets(documents)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# -- op9 ---------------------------------------------------------------------------------


def test_pieces_meet_every_token_boundary():
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(9)
    for _ in range(2000):
        text = "".join(rng.choices("ab 1.'s\n\t \x85\xa0é\x1c  ", k=rng.randint(0, 25)))
        pieces = PieceTable(lambda piece: piece).values_of(text)
        assert "".join(pieces) == text
        assert [t for p in pieces for t in pattern.findall(p)] == pattern.findall(text)


def test_bpe(documents, texts):
    encoded = bpe_codec.encode_documents(documents, RANKS, public_tokenizers.PATTERN, block_chars=5_000)
    out = bpe_codec.decode_documents(encoded, RANKS)
    got = by_id(out, (F.length("ids") / 4).cast("int"), F.sha2("ids", 256), F.sha2("data", 256))
    assert got == brute.bpe(texts)
    at_once = bpe_codec.encode_documents(documents, RANKS, public_tokenizers.PATTERN, decoded=True)
    assert by_id(at_once, "ids", "data") == by_id(out, "ids", "data")


def test_bpe_of_odd_rows(nothing, no_ids):
    for docs in (nothing, no_ids.coalesce(1)):
        encoded = bpe_codec.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
        data = bpe_codec.decode_documents(encoded, RANKS).select(F.decode("data", "utf-8").alias("t"))
        texts = docs.select(F.coalesce("text", F.lit("")).alias("t"))
        assert sorted(r.t for r in data.collect()) == sorted(r.t for r in texts.collect())


# -- op10 --------------------------------------------------------------------------------


def test_automaton_against_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, left = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(10)
    terms = [toxicity.Term("".join(rng.choices("abc", k=k)), False) for k in (3, 4, 5, 6, 7, 9, 10)]
    terms.append(toxicity.Term("bcab", True))
    automaton = toxicity.LexiconAutomaton(terms)
    for _ in range(5000):
        word = "".join(rng.choices("abcd", k=rng.randint(1, 12)))
        if rng.random() < 0.5:
            word = list(rng.choice(terms).text)
            for _ in range(rng.randint(0, 3)):
                word[rng.randrange(len(word))] = rng.choice("abcd")
            word = "".join(word)
        plain = [distance(word, t.text) for t in terms if not t.stem and distance(word, t.text) <= t.edits]
        plain += [0 for t in terms if t.stem and word.startswith(t.text)]
        found = automaton.match(word)
        assert (found is None) == (not plain), word
        if found and not word.startswith("bcab"):
            assert found[0] == min(plain)


def toxic_corpus(seed=11, n=900):
    from conftest import prose

    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(20, 120)).split(" ")
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                insult = rng.choice(["wretchling", "dunderpate", "mudsnout"])
                if rng.random() < 0.2:
                    insult = insult[:4] + "x" + insult[5:]
                words.insert(rng.randrange(len(words)), rng.choice([insult, insult.upper() + "!"]))
        elif i % 24 == 1:
            words[5:5] = ["he", "said", '"what', "a", "wretchling", 'indeed"', "quote"]
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    from conftest import frame

    rows, labels = toxic_corpus()
    docs = frame(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn_toxicity(docs, table)
    assert {"wretchling", "dunderpate", "mudsnout"} <= {t.text for t in model.terms} | {
        w for w in ("wretchling", "dunderpate", "mudsnout") if any(t.stem and w.startswith(t.text) for t in model.terms)
    }
    scored = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    import zlib

    held = [(i, toxic) for i, _, toxic in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((scored[i] >= 0.7) == bool(toxic) for i, toxic in held)
    assert right >= 0.95 * len(held)
    stays = toxicity.drop_toxic(docs, table)
    assert stays.columns == docs.columns
    assert stays.count() == sum(score < 0.7 for score in scored.values())


def test_labels_of_held_out_rows_are_not_used(spark):
    import zlib

    from conftest import frame

    rows, labels = toxic_corpus(n=300)
    docs = frame(spark, rows)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    models = [toxicity.learn_toxicity(docs, spark.createDataFrame(x, schema)) for x in (labels, flipped)]
    assert models[0].terms == models[1].terms
    assert models[0].weights == pytest.approx(models[1].weights)


def test_toxicity_of_odd_rows(spark, documents, nothing, no_ids):
    none = spark.createDataFrame([(None, 1, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    for docs in (documents, nothing, no_ids):
        model = toxicity.learn_toxicity(docs, none)
        scores = [r.score for r in toxicity.score_toxicity(docs, model).collect()]
        assert len(scores) == docs.count() and all(0 <= s < 0.7 for s in scores)
        assert toxicity.drop_toxic(docs, none).count() == docs.count()
