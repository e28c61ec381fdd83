"""Operators with one right answer against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lurescan.llm import decontaminate, fingerprints, html_text, license_scan, packing, pii, queries, simhash, text
from llm_helpers import FOLDER, read

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# ---- words and hashes


def test_words_of_touching_texts_stay_apart():
    texts = ["ab cd", "", "ef", "gh.", "é1"]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)]).astype(np.int64)
    low, begins, ends, first, hashes = decontaminate.words_of(np.frombuffer(b"".join(data), np.uint8), offsets)
    raw = low.tobytes()
    assert [raw[a:b].decode() for a, b in zip(begins, ends)] == ["ab", "cd", "ef", "gh", "é1"]
    assert first.tolist() == [0, 2, 2, 3, 4, 5]


def test_hash_depends_on_the_word_alone():
    words = [b"alpha", b"b", b"alpha", b"alphb", b"b"] * 300
    buf = np.frombuffer(b" ".join(words), np.uint8)
    inside = buf != 32
    begins, ends, _ = text.word_bounds(inside, np.array([0, len(buf)]))
    whole = text.word_hashes(buf, begins, ends)
    small = text.word_hashes(buf, begins, ends, block=64)
    assert (whole == small).all()
    by = defaultdict(set)
    for w, h in zip(words, whole):
        by[w].add(int(h))
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == 3


# ---- benchmark passages


def expected_hits(docs, items, window):
    windows = defaultdict(set)
    for item, t in items:
        w = WORD.findall(lowered(t))
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[i : i + size])].add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc, t in docs:
        w = WORD.findall(lowered(t))
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                ids = windows.get(tuple(w[i : i + size]))
                if ids:
                    found |= ids
                    hit |= set(range(i, i + size))
        named = sorted(str(i) for i in found if i is not None)  # an item without id hits, but has no name
        sha = hashlib.sha256(",".join(named).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(named), sha, bool(hit)))
    return Counter(out)


def got_hits(df):
    return Counter(tuple(r) for r in df.collect())


def test_passages_on_the_tables(spark):
    docs, items = read(spark, "documents"), read(spark, "benchmark")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    wanted = expected_hits(rows, [(r.item_id, r.text) for r in items.collect()], 10)
    assert got_hits(queries.QUERIES["op7_decontaminate"](spark, FOLDER)) == wanted


@pytest.mark.parametrize("block", [20_000, 1])
def test_passages_with_short_repeated_and_empty_items(spark, edge, monkeypatch, block):
    items = [
        (1, "Alpha BETA gamma."), (2, "one"), (3, ""), (4, None), (None, "beta"), (5, "alpha beta gamma"), (6, "wordy " * 12),
        (7, "two texts of one id"), (11, "東京"), (1, "beta gamma delta epsilon zeta eta theta iota kappa lambda mu"),
    ]
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, n_words int")
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    wanted = expected_hits(rows, [(i, t) for i, t in items if t], 10)
    matches = decontaminate.matches
    monkeypatch.setattr(decontaminate, "matches", lambda d, b, w: matches(d, b, w, block_items=block))
    assert got_hits(decontaminate.contamination(edge, benchmark)) == wanted


def test_passages_across_lanes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "LANE_WORDS", 7)
    docs = [(i, " ".join(f"w{(i * 7 + k * k) % 23}" for k in range(200))) for i in range(20)]
    items = [(k, " ".join(d.split()[k * 3 : k * 3 + 14])) for k, (_, d) in enumerate(docs)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = decontaminate.contamination(df, spark.createDataFrame(items, "item_id bigint, text string"))
    assert got_hits(found) == expected_hits(docs, items, 10)


# ---- near copies


def expected_print(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    ones = [0] * 64
    for h in (xxhash.xxh64_intdigest(s, 42) for s in shingles):
        for k in range(64):
            ones[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(shingles))


def components(prints, distance):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_near_copies_on_the_tables(spark):
    rows = sorted((r.doc_id, r.text) for r in read(spark, "documents").collect())
    prints = [expected_print(t) for _, t in rows]
    wanted = {d: (f"{p:016x}", rows[c][0]) for (d, _), p, c in zip(rows, prints, components(prints, 2))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op6_simhash"](spark, FOLDER).collect()}
    assert got == wanted


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("bucket", [64, 1, 0])
def test_links_of_close_fingerprints(spark, bucket, distance):
    """Chains, balls around one value and equal halves; small buckets force the exact way."""
    rng = np.random.default_rng(bucket * 10 + distance)
    prints = {0, 2**64 - 1}
    for centre in rng.integers(0, 2**63, 6).tolist():
        value = centre * 2
        for _ in range(25):
            for bit in rng.integers(0, 64, rng.integers(1, 4)).tolist():
                value ^= 1 << bit
            prints.add(value)
            prints.add(centre ^ (1 << int(rng.integers(0, 64))))
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    rank = spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "fp bigint, least bigint")
    links = simhash.neighbours(rank.select("fp"), distance, bucket=bucket)
    got = {r.fp: r.label for r in simhash.components(links, rank).collect()}
    wanted = components(prints, distance)
    assert [got.get(s, i) for i, s in enumerate(signed)] == wanted


def test_one_row_of_each_component_stays(spark, edge):
    kept = simhash.without_copies(edge)
    assert kept.columns == edge.columns
    prints = Counter(expected_print(r.text) for r in kept.collect())
    assert set(prints.values()) == {1} and set(prints) == {expected_print(r.text) for r in edge.collect()}
    assert {r.doc_id for r in kept.collect() if r.text and r.text.startswith("Alpha")} == {1}


# ---- packing


def check_packs(rows, ids, longest=2048):
    parts = defaultdict(list)
    for r in rows:
        whole = ids[r.doc_id]
        assert r.doc_tokens == len(whole)
        assert zlib.crc32(whole[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        parts[r.sequence_id].append((r.offset, r.length))
    for pieces in parts.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= longest
    return sum(longest - sum(n for _, n in p) for p in parts.values())


def test_packing_on_the_tables(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    docs = read(spark, "documents").collect()
    ids = {r.doc_id: np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 1], "<u4") for r in docs}
    rows = queries.QUERIES["op10_packing"](spark, FOLDER).collect()
    spare = check_packs(rows, ids)
    covered = Counter()
    for r in rows:
        covered[r.doc_id] += r.length
    assert covered == {d: len(x) for d, x in ids.items()}
    assert spare < 0.05 * sum(map(len, ids.values()))


def test_packing_edge_rows(spark, edge, none):
    rows = packing.pack(edge, with_ids=True, rows_per_group=2).collect()
    assert sum(r.start == 0 for r in rows) == edge.count()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert all(r.length == 1 and r.ids == [1] for r in rows if r.doc_id in (3, 4))
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("t", ["", "a <|endoftext|> b", "  two  spaces\n\n", "don't I'LL 123abc é東京", "\x00‍\U0001f600"])
def test_ids_equal_the_tokenizer(t):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    assert packing.encoder(path)(t) == Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids


def test_other_tokenizer_files_are_run_as_they_are():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.encoder(path)("Some Words here") == Tokenizer.from_file(path).encode(
        "Some Words here", add_special_tokens=False).ids


def test_shortest_pack_first_places_every_rank_once():
    rng = np.random.default_rng(1)
    histogram = {int(n): int(c) for n, c in zip(rng.integers(1, 65, 40), rng.integers(1, 50, 40))}
    places = packing.shortest_pack_first(histogram, 64)
    ranks, used = defaultdict(set), defaultdict(list)
    for length, low, high, first, offset in places:
        assert not ranks[length] & set(range(low, high))
        ranks[length] |= set(range(low, high))
        for k in range(high - low):
            used[first + k].append((offset, length))
    assert {n: len(r) for n, r in ranks.items()} == histogram
    for pieces in used.values():
        assert sum(n for _, n in pieces) <= 64
        assert [o for o, _ in sorted(pieces)] == np.cumsum([0, *(n for _, n in sorted(pieces))])[:-1].tolist()


# ---- fingerprints


def shingles(t):
    w = t.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({" ".join(w)} if w else set())


def test_fingerprints_of_whole_sets_on_the_tables(spark):
    """With every hash kept the likeness is the exact share of shingles."""
    docs = read(spark, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs, scale=1, rows_per_range=30).collect()}
    for (doc, t), (_, after) in zip(rows, [*rows[1:], rows[0]]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a = shingles(t)
        for other, share in ((edited, r.near_edited), (after, r.near_next)):
            assert share == pytest.approx(len(a & shingles(other)) / len(a))


def test_fingerprint_edges(spark, edge, none):
    rows = fingerprints.fingerprints(edge).collect()
    assert len(rows) == edge.count()
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.n_chars, r.fingerprint))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert by[1] == by[2] and by[3] == by[4] == {(0, "")}
    assert fingerprints.fingerprints(none).count() == 0
    single = edge.filter("doc_id = 1")
    assert fingerprints.fingerprints(single).first().near_next == 1.0


def test_sketches_keep_the_share_and_estimate(spark):
    texts = spark.range(40).selectExpr("id AS doc_id", "array_join(transform(sequence(0, 1999), i -> cast(i * (id + 1) AS string)), ' ') AS text")
    sizes = [len(r.fingerprint) // 16 for r in fingerprints.fingerprints(texts, scale=8).collect()]
    assert abs(np.mean(sizes) / (1996 / 8) - 1) < 0.1


def test_short_texts_inside_long_ones(spark):
    """A text without a hash below the threshold is looked for among all hashes of the other text."""
    words = [f"w{i * i % 997}" for i in range(4000)]
    rows = []
    for k in range(40):
        short = " ".join(words[k * 100 : k * 100 + 7])
        rows += [(2 * k, short), (2 * k + 1, " ".join(words[k * 100 + 50 : k * 100 + 90]) + " " + short)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert all(r.near_next == 1 for r in fingerprints.fingerprints(docs).collect() if r.doc_id % 2 == 0)

    cut = lambda s: {s[i : i + 16] for i in range(0, len(s), 16)}
    docs = docs.unionByName(read(spark, "documents").selectExpr("doc_id + 100 AS doc_id", "text"))
    whole = {r.doc_id: r for r in fingerprints.fingerprints(docs, scale=1).collect()}
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    ids = sorted(got)
    lone = 0
    for i, after in zip(ids, [*ids[1:], ids[0]]):
        if len(got[i].fingerprint) == 16 and int(got[i].fingerprint, 16) ^ 2**63 > 2**61:
            lone += 1
            assert got[i].near_edited == (got[i].fingerprint in cut(whole[i].edited_fingerprint))
            assert got[i].near_next == (got[i].fingerprint in cut(whole[after].fingerprint))
    assert lone > 10


# ---- licenses


def test_license_edges(edge, none):
    got = {(r.doc_id, r.n_words): r for r in license_scan.scan(edge).collect()}
    long = got[(7, 30_000 + 6)]
    assert (long.n_base, long.first_word, long.labels) == (1, 30_001, "mit")
    apache = next(r for k, r in got.items() if r.base_labels == "apache-2")
    assert (apache.first_word, apache.n_base) == (3, 1)
    assert got[(3, 0)].n_base == 0 and got[(3, 0)].first_word is None and got[(3, 0)].score == 0
    assert license_scan.scan(none).count() == 0


def test_license_blocks_with_a_changed_word(spark):
    rows = [(1, "This wrk is licensed under the GNU General Public License, version 3.\nUnder the MIT license under the MIT license"),
            (2, "licensed gnu"), (3, "cc-by-nc\nCC BY NC")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert (got[1].labels, got[1].n_base, got[1].base_labels) == ("gpl-3,mit", 2, "mit")
    assert got[2].labels == "" and (got[3].n_base, got[3].first_word, got[3].last_word) == (2, 0, 3)


def test_license_names_must_stand_and_tokens_must_be_near(spark):
    isc = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
    far = " ".join(w + " word" * 40 for w in isc.split())
    rows = [(1, "Released under the BSD license"), (2, "Licensed under the Mozilla Public License, Version 2.0"),
            (3, "Licensed under CC BY 4.0\nLicensed under CC BY-SA 4.0"), (4, "Released under the MIT license"),
            (5, "word " * 500 + isc + " word" * 500), (6, far), (7, "Licensed under Apache License, Version 2.0")]
    got = {r.doc_id: r.labels for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: "", 2: "", 3: "", 4: "mit", 5: "isc", 6: "", 7: "apache-2"}


def test_wrapped_license_notices(spark):
    rows = [(1, "x\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided "
                "that the following conditions are met:\ny"),
            (2, "you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by "
                "the Free Software Foundation"),
            (3, "word " * 100 + "\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software "
                "and associated documentation files, to deal\nin the Software without restriction\n" + "word " * 100)]
    got = {r.doc_id: r.labels for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: "bsd", 2: "gpl", 3: "mit"}


def test_rival_licenses(spark):
    terms = ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {}General Public "
             "License as published by\nthe Free Software Foundation, either version {} of the License")
    rows = [
        (1, "Licensed under a Creative Commons Attribution 4.0 International License", ""),
        (2, "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
        (3, "This work is licensed under the GNU General Public License version 2", "gpl-2"),
        (4, "This work is licensed under the GNU Lesser General Public License version 3", "lgpl"),
        (5, "This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
        (6, terms.format("", 2), "gpl-2"), (7, terms.format("", 3), "gpl-3"), (8, terms.format("Lesser ", 3), "lgpl"),
        (9, "made available under the terms of the Eclipse Public License, v. 2.0", "epl-2"),
        (10, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2"),
        (11, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
             "following conditions are met:\n * Neither the name of the copyright holder nor the names of its\ncontributors may be "
             "used to endorse or promote products derived from\nthis software without specific prior written permission.", "bsd-3"),
        (12, "This work is licensed under the GNU Affero General Public License", "agpl"),
        (13, "Licensed under a Creative Commons Attribution-Non-Commercial 4.0 International License", "cc-by-nc"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    assert {r.doc_id: r.labels for r in license_scan.scan(df).collect()} == {r[0]: r[2] for r in rows}


# ---- base patterns of personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        digits = [int(c) for c in m[0] if c.isdigit()]
        twice = [d * 2 - 9 * (d > 4) if k % 2 else d for k, d in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(twice) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_spans_equal_the_patterns(spark):
    rng = np.random.default_rng(4)
    pieces = ["a@b.c", "@x.y", "x@y", ".@.", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.02.3.4", "4111111111111111",
              "4111 1111 1111 1111", "+1 555 010 4477", "+1", "+49-(30) 12", "é", " ", "@", "-", "..", "7", "+++", "a.b+c_d%e"]
    texts = ["".join(rng.choice(pieces, rng.integers(1, 12))) for _ in range(3000)]
    texts += [r.text for r in read(spark, "documents").collect()]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t


def test_long_runs_take_linear_time():
    for t in ("9" * 200_000, "a" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000):
        pii.base_spans(t)


def test_broken_utf8_does_not_stop_a_task(spark):
    """Bytes that are no UTF-8 can reach a string column through a cast."""
    df = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF62204D') AS string) AS text, cast(unhex('3C703EFF') AS string) AS html, 'u' AS url")
    assert packing.pack(df).count() == 1
    assert decontaminate.contamination(df, spark.createDataFrame([(1, "x")], "item_id int, text string")).first().n_hit == 0
    assert simhash.near_duplicates(df).count() == 1
    field = html_text.train(html_text.labelled_pages(20), rounds=5)
    assert html_text.extract(df, field, ["doc_id"]).count() == 1


@pytest.mark.parametrize("run", [" ", "\n", " \t\n", " ", "a", "7", "-", "东"])
def test_long_runs_give_the_ids_of_the_file(run):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    text = f"before{run * (2_000_000 // len(run))}after  the run"
    assert packing.encoder(path)(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_blank_runs():
    for blank in (" ", " ", "\n\t"):
        assert packing.has_blank_run("x" + blank * 40 + "y", 40) and not packing.has_blank_run("x" + "y".join([blank * 15] * 9), 40)
    assert not packing.has_blank_run("东" * 100, 40) and not packing.has_blank_run("", 40)


def test_items_without_id_drop_documents(spark, edge):
    items = spark.createDataFrame([(None, "one"), (None, None)], "item_id bigint, text string")
    rows = {r.doc_id: r for r in decontaminate.contamination(edge, items).collect()}
    assert (rows[6].n_hit, rows[6].n_items, rows[6].contaminated) == (1, 0, True)
    left = decontaminate.clean_documents(edge, items).collect()
    assert 6 not in {r.doc_id for r in left} and 4 in {r.doc_id for r in left}
