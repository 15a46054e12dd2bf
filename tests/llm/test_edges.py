"""Clashing columns, recounts by independent code, and readers that share nothing with the writers."""

import hashlib
import math
import random
import re
import struct
from collections import Counter
from functools import partial

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from pageframe.llm import chat, common, langid, mixing, queries, sharding, warc

CLASH = "_key _is _n _copies _copy _t _group _x0 _x1 _x2 slot shard n_words rep label h key size".split()


def test_stages_keep_clashing_columns(spark, odd_docs):
    docs = odd_docs.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in CLASH])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[c] == f"{c} {'-' if r.doc_id is None else r.doc_id}" for c in CLASH), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_sharding_names(spark):
    df = spark.createDataFrame([(1, 7, "s"), (None, 8, "t"), (None, 8, "t")], "doc_id long, slot int, shard string")
    replaced, beside = sharding.placed(df, "doc_id"), sharding.placed(df, "doc_id", slot="at", shard="to")
    assert replaced.columns == ["doc_id", "slot", "shard"] and beside.columns == ["doc_id", "slot", "shard", "at", "to"]
    assert sorted((r.slot, r.shard) for r in replaced.collect()) == sorted((r["at"], r["to"]) for r in beside.collect())
    assert sharding.placed(df, "slot").count() == 3 and {r.slot for r in beside.collect()} == {7, 8}


def test_shared_folder_must_be_set_on_clusters():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            _jsc = type("J", (), {"sc": lambda self: type("C", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)


def test_language_scores_from_the_weights(spark):
    """Predictions recomputed from the fitted weights with features counted letter by letter."""
    rng = random.Random(9)
    syllables = {"en": "the ing th ou ght", "de": "sch ein ung cht", "nl": "een ij van oor", "fr": "eau oi que eux", "es": "ción ll ar ñ", "fi": "kkä yt een uu"}
    rows = [(i, " ".join("".join(rng.choices(syllables[c].split(), k=3)) for _ in range(12)) + rng.choice(("", "!", " 12 A")), c) for i, c in enumerate(list(syllables) * 25)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learned(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(df, model).collect()}
    mask = 0xFFFFFFFF

    def counted(text):
        codes, gap = [], False
        for ch in text.lower():
            if ch.isalpha() or not gap:
                codes.append(ord(ch) if ch.isalpha() else 32)
            gap = not ch.isalpha()
        v = np.zeros(model.dims)
        pair = lambda a, b: (a * 0x9E3779B1 + b * 0x85EBCA77) & mask
        for k, c in enumerate(codes):
            found = [c * 0x165667B1 & mask]
            found += [pair(c, codes[k + 1])] if k + 1 < len(codes) else []
            found += [(pair(c, codes[k + 1]) * 0xC2B2AE3D + codes[k + 2] * 0x27D4EB2F) & mask] if k + 2 < len(codes) else []
            for g in found:
                v[(g ^ g >> 15) % model.dims] += 1
        v = np.sqrt(v)
        return np.append(v / np.linalg.norm(v), 1.0)

    sure = lambda m: 1 / (1 + math.exp(-4 * m))
    for i, text, _ in rows:
        x = counted(text)
        margins = sorted(((float(w @ x), f) for w, f in zip(model.by_family, model.families, strict=True)), reverse=True)
        family, score = margins[0][1], sure(margins[0][0] - margins[1][0])
        names, votes, sums = model.languages[family], Counter(), Counter()
        for a, b, w in model.pairs[family]:
            m = float(w @ x)
            votes[names[a] if m >= 0 else names[b]] += 1
            sums[names[a]] += m
            sums[names[b]] -= m
        best = max(names, key=lambda n: (votes[n], sums[n]))
        score *= sure(sums[best] / (len(names) - 1)) if len(names) > 1 else 1
        assert got[i][0] == best and got[i][1] == pytest.approx(score, abs=1e-4)


def test_language_sample_is_bounded_and_fixed(spark):
    rows = [(i % 50, f"text number {i % 70} here", ("en", "fr", "xx")[i % 50 % 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fit = langid.Fit(per_language=5, max_languages=2, rows=8, epochs=2)
    one, two = langid.learned(df, fit), langid.learned(df.repartition(7), fit)
    assert sum(map(len, one.languages.values())) == 2 and np.array_equal(one.by_family, two.by_family)


def test_mixing_of_heavy_tails(spark):
    """One document of half a source's words; the small ones make up what it cannot take in part."""
    for share, small, n, large in ((0.4, 100, 1000, 100000), (0.8, 100, 1000, 100000), (1.8, 100, 1000, 100000), (0.4, 100, 3000, 1000000)):
        sized = [("a", small)] * n + [("a", large)] + [("b", 7)] * 11 + [("b", 40)]
        counts = spark.createDataFrame([("a", small, n), ("a", large, 1), ("b", 7, 11), ("b", 40, 1)], "key string, size long, n long")
        size = {k: sum(s for kk, s in sized if kk == k) for k in "ab"}
        sources = spark.createDataFrame([(k, size[k], 2.0 * size[k], 1.0, share * size[k]) for k in "ab"], "key string, source_size long, cap double, weight double, target double")
        state = mixing.duals(counts, sources, mixing.Mix(max_steps=39))
        got = Counter()
        for r in mixing.copies_by_size(counts, state).collect():
            assert 0 <= r.total <= 2 * sized.count((r.key, r.size))
            got[r.key] += r.total * r.size
        assert abs(got["a"] - share * size["a"]) <= small / 2 and abs(got["b"] - share * size["b"]) <= 3.5


def test_mixing_of_a_large_document_in_whole(spark):
    rows = [(i, "w " * 100, "a") for i in range(400)] + [(1000, "w " * 40000, "a")] + [(2000 + i, "w " * 50, s) for i, s in enumerate("bcdef" * 300)]
    source, taken, target = {i: s for i, _, s in rows}, Counter(), {}
    for r in mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        assert r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert len(target) == 6 and all(abs(taken[s] - t) <= (50 if s == "a" else 25) for s, t in target.items())


def test_mixing_rates_are_the_entropy_balance(spark):
    """Duals found again by bisection, and copies by the documents' own order."""
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice((1, 2, 5, 9, 30)), rng.choice("aabc")) for i in range(500)]
    found = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {i: (t.count("w"), s) for i, t, s in rows}
    for s in "abc":
        own = [r for r in found if by[r.doc_id][1] == s]
        sizes, target = [r.size for r in own], own[0].target
        scale = sum(n * n for n in sizes) / sum(sizes)
        rate = lambda dual, n: 2 / (1 + math.exp(-dual * n / scale))  # noqa: E731, B023
        if target < 2 * sum(sizes) - 1e-9:
            low, high = -50.0, 50.0
            for _ in range(200):
                mid = (low + high) / 2
                low, high = (mid, high) if sum(n * rate(mid, n) for n in sizes) < target else (low, mid)
            assert all(r.rate == pytest.approx(rate(low, r.size), abs=1e-5) for r in own)
            assert sum(r.rate * r.size for r in own) == pytest.approx(target, rel=1e-6)
        assert all(math.floor(r.rate) <= r.copies <= math.ceil(r.rate) for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 0.5 * max(sizes) + 1e-6
    with pytest.raises(ArithmeticError):
        mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string"), mixing.Mix(max_steps=1)).count()


def test_archives_by_another_reader(spark):
    """Frames by the library's stream reader, headers by patterns: every record has what WARC/1.1 asks for, and ids are unique."""
    rows = [(i, None if i % 9 == 0 else f"http://h/{i}", "é payload " * (i % 7)) for i in range(60)] + [(None, "http://n/", "x")] * 3 + [(5, "http://h/5", "é payload " * 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    ids, kinds, refers = [], Counter(), []
    for r in warc.archives(warc.planned(df.repartition(3))).collect():
        magic, size = struct.unpack_from("<II", r.data)
        assert magic & 0xFFFFFFF0 == 0x184D2A50
        made = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(r.data[8 : 8 + size])).stream_reader(r.data[8 + size :], read_across_frames=True).read()
        at = 0
        while at < len(made):
            head = made[at:].partition(b"\r\n\r\n")[0].decode()
            assert head.startswith("WARC/1.1\r\n")
            field = partial(lambda head, name: (re.search(rf"^{name}: (.*?)\r?$", head, re.M) or [None, None])[1], head)
            assert re.fullmatch(r"<urn:\S+>", field("WARC-Record-ID")) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", field("WARC-Date")) and field("WARC-Target-URI")
            length = int(field("Content-Length"))
            block = made[at + len(head.encode()) + 4 :][: length + 4]
            assert len(block) == length + 4 and block.endswith(b"\r\n\r\n")
            body = block[:-4].partition(b"\r\n\r\n")[2]
            if field("WARC-Type") == "response":
                import base64

                assert field("WARC-Payload-Digest") == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
            else:
                assert not body and field("WARC-Profile")
                refers.append(field("WARC-Refers-To"))
            ids.append(field("WARC-Record-ID"))
            kinds[field("WARC-Type")] += 1
            at += len(head.encode()) + 4 + length + 4
    assert len(ids) == len(set(ids)) == len(rows) and set(refers) <= set(ids) and kinds["response"] == 7 + 3


def test_archive_of_a_page_of_many_megabytes(spark):
    rows = [(1, "u", "abc " * 3_000_000), (2, "u", "short"), (3, None, "abc " * 3_000_000)]
    got = {r.page_id: (r.record_type, r.payload_bytes, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("response", 12_000_000, None), 2: ("response", 5, None), 3: ("revisit", 12_000_000, 1)}


def test_a_line_that_a_conversation_repeats(spark):
    """Who said a line last, for every turn of a conversation that keeps quoting and saying it, against a walk."""
    rng, rows, last, wanted = random.Random(1), [], {}, {}
    for t in range(3000):
        line = rng.choice(("yes", "no", "well"))
        quote = rng.random() < 0.4
        rows.append((7, t * 1_000_000_000_000, "u", f"> {line}\nabout {t}" if quote else line))
        if quote:
            wanted[t * 1_000_000_000_000] = last.get(line)
        else:
            last[line] = t * 1_000_000_000_000
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r.parent_turn for r in chat.reply_ordered(df).collect()}
    assert len(got) == 3000 and all(got[t] == p for t, p in wanted.items())


def test_quoting_mails_link(spark):
    rows = [(c, t, "r", f"Text {c} {t}\nwith   lines\n\nand more") for c in range(3) for t in range(9)]
    found = chat.reply_ordered(queries.quoting(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert all(r.parent_turn == (r.turn - 1 if r.turn % 3 else None) and r.n_quotes == r.turn % 3 for r in found)
