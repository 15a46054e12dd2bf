"""The operators on documents against brute force, on odd rows and on an empty table."""

import hashlib
import re
import string
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from pageframe.llm import bpe, fingerprint, langid, mixing, ngram_join, quality, sharding

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def shingles(text, n):
    w = words((text or "").translate(FOLD))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_quality(spark, odd_docs, no_docs):
    rows = {(r.doc_id, r.n_words): r for r in quality.verdicts(odd_docs).collect()}
    assert quality.verdicts(no_docs).count() == 0
    for d in odd_docs.collect():
        w = words(d.text)
        r = rows[d.doc_id, len(w)]
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if seen[g] > 1 for k in range(3)}
        lines = [x for x in (d.text or "").split("\n") if words(x)]
        assert (r.word_chars, r.n_repeat_words, r.n_dup_lines) == (sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in d.text or "")
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_quality_of_empty_texts_beside_references(spark):
    rows = [(i, " ".join(f"the w{i} and x{i + k} of" for k in range(40)), "en") for i in range(20)]
    odd = [(100, None, "en"), (101, "", "en"), (102, "", None), (103, None, "fi")]
    for more in ([], odd):
        df = spark.createDataFrame(rows + more, "doc_id long, text string, lang string")
        found = {r.doc_id: r for r in quality.judge(df).collect()}
        assert len(found) == len(rows) + len(more) and all(found[i].nearest_lang == "en" for i in range(20))
        assert {(r.base_failed, r.kept) for i, r in found.items() if i >= 100} == ({(True, False)} if more else set())
        plain = sorted((i, found[i].kept, round(found[i].js_words, 9)) for i in range(20))
        assert plain == (kept := plain if not more else kept)  # they change nothing of the others


def test_quality_drops_symbols_and_keeps_prose(spark):
    import random

    rng = random.Random(3)
    some = lambda: " ".join(rng.choice("the of and to in is it was for on with as by river stone green walk seven house early".split()) + str(rng.randrange(9)) * (rng.random() < 0.02) for _ in range(300))
    good = [(i, some(), "en") for i in range(30)]
    bad = [(100 + i, " ".join(w + "###" for w in some().split()), "en") for i in range(3)]
    kept = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(good + bad, "doc_id long, text string, lang string")).collect()}
    assert all(kept[i] for i in range(30)) and not any(kept[100 + i] for i in range(3))


def test_quality_keeps_rare_languages(spark):
    import random

    rng = random.Random(4)
    prose = lambda words, n: " ".join(rng.choice(words.split()) + rng.choice("abcdefgh") * (rng.random() < 0.3) for _ in range(n))
    hot, rare = "the of and to in is it was for on with as by river stone green walk seven house early", "ja ei se on hän oli mutta kun niin talo joki kivi metsä vihreä seitsemän aikainen kulkea"
    rows = [(i, prose(hot, 20000), "en") for i in range(200)] + [(1000 + i, prose(rare, 300), "fi") for i in range(12)] + [(2000, prose(rare, 300), "et")]
    kept = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(kept[1000 + i] for i in range(12)) and kept[2000]
    few = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(rows[:20] + rows[-1:], "doc_id long, text string, lang string")).collect()}
    assert few[2000]


def _prose_of(rng, n_languages, shared="la de un"):
    """Rows (doc_id, text, lang): languages with words of their own, three that all have, and rare ones."""
    rows = []
    for lang in range(n_languages):
        own = [f"{a}{lang:x}{b}" for a in ("k", "mo", "ti") for b in ("a", "el", "os", "u")]
        for i in range(3):
            rows.append((len(rows), " ".join(rng.choice(own + shared.split()) if rng.random() < 0.9 else f"r{rng.randrange(10**6)}" for _ in range(900)), f"l{lang}"))
    return rows


def _distances(rows, rules):
    """{doc_id: (nearest, its distances)} by plain counting."""
    import math
    import unicodedata

    kind = lambda c: ("space" if c in " \t\n\v\f\r" else {"Ll": "lower", "Lu": "upper", "Lt": "upper", "Nd": "digit"}.get(unicodedata.category(c)) or ("stop" if c in ".,;:?'()-" else "other"))
    js = lambda p, q: sum((x * math.log2(2 * x / (x + y)) if x else 0) / 2 + (y * math.log2(2 * y / (x + y)) if y else 0) / 2 for x, y in zip(p, q, strict=True))
    by_words, by_chars = {}, {}
    for _, text, lang in rows:
        by_words.setdefault(lang, Counter()).update(text.lower().split())
        by_chars.setdefault(lang, Counter()).update(map(kind, text))
    heavy = {lang: {w: n / sum(c.values()) for w, n in c.items() if n >= rules.common_share * sum(c.values())} for lang, c in by_words.items()}
    out = {}
    for at, text, _ in rows:
        n, chars, total = Counter(text.lower().split()), Counter(map(kind, text)), len(text.split())
        each = []
        for lang, q in heavy.items():
            p = [n[w] / total for w in q]
            words_apart = math.sqrt(js([*p, 1 - sum(p)], [*q.values(), 1 - sum(q.values())]))
            of = by_chars[lang]
            chars_apart = math.sqrt(max(js([chars[k] / len(text) for k in of], [v / sum(of.values()) for v in of.values()]), 0))
            each.append((max(chars_apart - rules.max_chars, words_apart - rules.max_words), lang, chars_apart, words_apart))
        out[at] = min(each)[1:]
    return out


def test_quality_of_two_hundred_languages(spark):
    """Every row's nearest language and its distances against plain counting; the plan has as many expressions as with two languages."""
    import random

    sizes = {}
    for n in (2, 200):
        rows = _prose_of(random.Random(n), n)
        found = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        got = {r.doc_id: (r.nearest_lang, r.js_chars, r.js_words) for r in found.collect()}
        for at, (lang, chars, apart) in _distances(rows, quality.DEFAULT).items():
            assert got[at][0] == lang == rows[at][2] and abs(got[at][1] - chars) < 1e-6 and abs(got[at][2] - apart) < 1e-9
        sizes[n] = found._jdf.queryExecution().analyzed().toString().count("lambdafunction")
    assert sizes[2] == sizes[200] > 0


def test_quality_counts_words_alike_beyond_the_broadcast(spark):
    import random

    df = spark.createDataFrame(_prose_of(random.Random(5), 5), "doc_id long, text string, lang string")
    few, many = (sorted(map(tuple, quality.common_words(df, broadcast_rows=n).collect())) for n in (1 << 18, 0))
    assert few == many and len({lang for lang, *_ in few}) == 5


def test_quality_vocabulary(spark):
    words_of = [f"w{i}" for i in range(30_000)]
    vocabulary = quality.Vocabulary.of(spark, words_of)
    assert sorted(w for b in vocabulary.buckets for w in b) == sorted(words_of) and max(map(len, vocabulary.buckets)) < 10
    df = spark.createDataFrame([(words_of[:500] + ["no", "W7"],)], "w array<string>").select(vocabulary.known(F.col("w")).alias("known"))
    assert df.first().known == words_of[:500] + ["w7"]


def test_language_filter_rejects_unlearned_languages(spark):
    import random

    rng = random.Random(6)
    syllables = {"en": "the ing th ou ght wh", "de": "sch ein ung cht ber keit", "ja": "ka mi no ri to shi"}
    some = lambda s: " ".join("".join(rng.choices(s.split(), k=3)) for _ in range(40))
    other = ["pła rze wią dzy czę szcz", "при вет мир дом лес гор", "xq zvk wqj pfx kzz jq", "ğı şü öz yı lar üm"]
    for learned in (["en"], ["en", "de"], ["en", "de", "ja"]):
        rows = [(i, some(syllables[c]), c) for i, c in enumerate(learned * 60)] + [(10_000 + i, some(x), None) for i, x in enumerate(other * 5)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        assert {r.doc_id for r in langid.kept(df).collect()} == set(range(60 * len(learned)))


def test_language_id(spark, odd_docs, no_docs):
    found = langid.cross_checked(odd_docs).collect()
    assert len(found) == 13 and langid.cross_checked(no_docs).count() == 0
    by = defaultdict(set)
    for r in found:
        by[r.doc_id].add(r.lang_pred)
        assert 0 <= r.score <= 1
    assert by[3] == by[4] == by[5] == by[9] == {"und"} and "und" not in by[1] | by[11]
    assert {r.lang_pred for r in langid.cross_checked(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_id_held_out(spark):
    import random

    rng = random.Random(5)
    syllables = {"en": "the ing th ou ght wh", "de": "sch ein ung cht ber keit", "fr": "eau oi que ai eux ment", "es": "ción que ll ar ado ñ"}
    rows = [(i, " ".join("".join(rng.choices(syllables[lang].split(), k=3)) for _ in range(40)), lang) for i, lang in enumerate(list(syllables) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.cross_checked(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 20 and sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)


def test_bpe_is_tiktokens(spark, odd_docs, no_docs):
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    wanted = sorted((len(i := own.encode_ordinary(r.text or "")), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in i)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd_docs.collect())
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(odd_docs, RANKS, PATTERN).collect()) == wanted
    assert bpe.digests(no_docs, RANKS, PATTERN).count() == 0
    ids = odd_docs.select("text", bpe.encode_column(F.col("text"), RANKS, PATTERN).alias("ids"))
    back = ids.select("text", bpe.decode_column(F.col("ids"), RANKS, PATTERN).cast("string").alias("back")).collect()
    assert all((r.text or "") == r.back for r in back)


@pytest.mark.parametrize("text", ["a" * 3000, "  \n\n \t x", "don't I'll", "漢字かな交じり", "<|endoftext|>", "\x1c a\x85b  c", ""])
def test_bpe_pieces(text):
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    codec = bpe.codec(RANKS, PATTERN)
    assert codec.encode(text) == own.encode_ordinary(text) and codec.decode(codec.encode(text)) == text.encode()


def test_prefix_tables_append_and_edit():
    import random

    rng, v = random.Random(1), bpe.codec(RANKS, PATTERN).vocabulary
    table = bpe.PrefixTable(v, b"")
    for _ in range(300):
        table.append(bytes([rng.choice(b" thereandon")]))
    assert table.last == bpe.PrefixTable(v, table.data).last
    for _ in range(60):
        at = rng.randrange(len(table.data))
        computed = table.replace(at, min(len(table.data), at + rng.randrange(4)), bytes(rng.choices(b"thereand ", k=rng.randrange(4))))
        assert table.last == bpe.PrefixTable(v, table.data).last and computed <= len(table.data)


def test_tokens_that_end_at_a_byte_are_one_step_each():
    import random

    rng, v = random.Random(2), bpe.codec(RANKS, PATTERN).vocabulary
    table = bpe.PrefixTable(v, bytes(rng.choices(b" thereandonings\xe6\xbc", k=200)))
    for end, state in enumerate(table.states, 1):
        token, found = v.ends[state], []
        while token >= 0:
            found.append(v.tokens[token])
            token = v.shorter[token]
        assert found == [table.data[i:end] for i in range(end) if table.data[i:end] in v.ranks]


def test_mixing_meets_targets(spark, odd_docs, no_docs):
    rows = [(i, " ".join("w" for _ in range(1 + i * 7 % 40)), f"s{i % 5}") for i in range(600)] + [(1000, "w " * 30, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mixed(df).collect()
    assert {(r.doc_id, r.taken) for r in found} == {(r.doc_id, r.taken) for r in mixing.mixed(df.repartition(3)).collect()}
    size, key = Counter(), lambda s: (s is None, s or "")
    for i, t, s in rows:
        size[s] += len(words(t))
    target, left, free = {}, 1.5 * sum(size.values()), {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=key))}
    while free:
        level = left / sum(free.values())
        full = {s for s, w in free.items() if w * level >= 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in full} or {s: w * level for s, w in free.items()}
        left -= sum(2 * size[s] for s in full)
        free = {s: w for s, w in free.items() if full and s not in full}
    source, taken = {i: s for i, _, s in rows}, Counter()
    for r in found:
        assert r.source_size == size[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]]) and r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 40 for s in size)
    odd = mixing.mixed(odd_docs).collect()
    assert len(odd) == 13 and all(r.taken == 0 for r in odd if not r.size) and mixing.mixed(no_docs).count() == 0
    assert mixing.repeated(odd_docs).columns == odd_docs.columns


def test_fingerprints(spark, odd_docs, no_docs):
    docs = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in fingerprint.compared(docs).collect()}
    true = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0

    def five(text):
        w = words(text)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    for i, r in enumerate(rows):
        a, b = r.text or "", rows[(i + 1) % len(rows)].text or ""
        half = len(a) // 2
        edited, g = a[: len(a) - half] + b[:half], got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(g.near_edited - true(five(a), five(edited))) < 0.2 and abs(g.near_next - true(five(a), five(b))) < 0.2
        assert abs(g.shingles - len(five(a))) <= 0.35 * len(five(a))
    same = [r.fingerprint for r in fingerprint.compared(odd_docs).where("doc_id = 1 OR doc_id = 2 OR doc_id IS NULL").collect()]
    assert len(same) == 3 and len(set(same)) == 1 and fingerprint.compared(no_docs).count() == 0
    one = fingerprint.compared(odd_docs.where("doc_id = 1")).first()
    assert one.near_next == 1.0


def test_sketches_merge(spark):
    parts = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(300))), (1, " ".join(f"a{i}" for i in range(200, 500))), (2, "")], "k int, text string")
    sketched = parts.select("k", fingerprint.sketch(F.col("text"), 64).alias("s"))
    whole = sketched.where("k = 1").collect()
    merged = {r.k: r.s for r in fingerprint.merge_by(sketched, ["k"], "s", 64).collect()}
    assert merged[1] == sorted(set(whole[0].s) | set(whole[1].s))[:64]


def brute(rows, width, percent):
    sets, parent = [(r.doc_id, shingles(r.text, width)) for r in rows], {}
    ids = [i for i, _ in sets if i is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return sorted(((i, len(x), find(i) if i is not None else None) for i, x in sets), key=str)


def test_ngram_join(spark, odd_docs, no_docs):
    import random

    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(400)]
    rows, base = list(odd_docs.select("doc_id", "text").collect()), [rng.choices(vocabulary, k=rng.choice((3, 8, 30, 120))) for _ in range(12)]
    made = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 5))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        made.append((100 + i, " ".join(w) + rng.choice(("", "", " common passage that many of these texts share"))))
    df = odd_docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    rows = df.collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.linked(df).collect()), key=str)
    assert got == brute(rows, 4, 85)
    assert ngram_join.linked(no_docs).count() == 0


def test_one_of_each(spark, odd_docs):
    kept = ngram_join.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 9]  # 8 has prose too, but also a text of its own


@pytest.mark.parametrize(("few", "peels"), [(2, 0), (2, 1), (4, 12)])
def test_long_lists_lose_no_link(spark, few, peels):
    """Near copies of few texts, most of them with no link to the smallest of their lists, however the lists are taken apart."""
    import random

    rng, join = random.Random(few + peels), ngram_join.Join(width=2, percent=70, few=few, peels=peels)
    vocabulary = [f"v{i}" for i in range(60)]
    base = [rng.choices(vocabulary, k=24) for _ in range(3)]
    rows = []
    for i in range(160):
        w = list(base[i % 3])
        for _ in range(rng.choice((1, 2, 2, 3, 3, 4))):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choices(vocabulary[:8], k=rng.choice((0, 1, 1, 2)))
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.linked(df, join).collect()), key=str) == brute(df.collect(), 2, 70)


@pytest.mark.parametrize(("few", "hubs", "compares"), [(2, 1, 0), (4, 2, 64)])
def test_lists_of_several_components_lose_no_link(spark, few, hubs, compares):
    """Long lists in all their ways: members outside the commonest component paired, compared, or taken apart by hubs."""
    import random

    rng, join = random.Random(few + hubs + compares), ngram_join.Join(width=2, percent=70, few=few, hubs=hubs, peels=2, compares=compares)
    vocabulary = [f"v{i}" for i in range(60)]
    base, rows = rng.choices(vocabulary, k=24), []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice((1, 2, 3, 5, 6))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary[:12])
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.linked(df, join).collect()), key=str) == brute(df.collect(), 2, 70)


def test_long_lists_stay_whole_where_few_pairs_may_link(spark, monkeypatch):
    """Near copies in long lists of several components: what lies between them is few, and no list is taken apart by n-grams."""
    import random

    made, step = [], ngram_join.rekeyed
    monkeypatch.setattr(ngram_join, "rekeyed", lambda *given: (out := step(*given), made.append(out.count()))[0])
    rng, join = random.Random(16), ngram_join.Join(width=2, percent=70, few=4, peels=1)
    vocabulary = [f"v{i}" for i in range(60)]
    base, rows = [rng.choices(vocabulary, k=24) for _ in range(3)], []
    for i in range(160):
        w = list(base[i % 3])
        for _ in range(rng.choice((1, 2, 2, 3, 3, 4))):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choices(vocabulary[:8], k=rng.choice((0, 1, 1, 2)))
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.linked(df, join).collect()), key=str) == brute(df.collect(), 2, 70)
    assert sum(made) == 0, made


def test_one_of_each_judges_texts(spark):
    rows = [(1, "a b c d e f g", 0, "x"), (8, "this text nobody else has at all", 1, "y"), (8, "a b c d e f g", 2, "z"), (8, "a b c d e f g", 2, "z"), (9, None, 3, None), (9, None, 3, None), (None, "a b c d e f g", 4, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _n int, _x0 string")
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[1], rows[4], rows[5], rows[6]], key=str)


def test_repeated_ids_keep_all_their_texts(spark):
    some = lambda k, n=60: " ".join(f"{k}{i}" for i in range(n))
    rows = [(5, some("a")), (5, some("b")), (5, some("c")), (6, some("a") + " x"), (7, some("b") + " x"), (8, some("c") + " x"), (9, some("d")), (9, some("d") + " x"), (9, some("e")), (9, some("e"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.linked(df).collect()} == {(5, 5), (6, 5), (7, 5), (8, 5), (9, 9)}
    kept = [(r.doc_id, r.text[0]) for r in ngram_join.one_of_each(df).collect()]
    assert sorted(kept) == [(5, "a"), (5, "b"), (5, "c"), (9, "d"), (9, "e")]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (200, 200)], "a long, b long")
    got = {r.node: r.label for r in ngram_join.components(links).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, 101: 100}


def test_sharding(spark, odd_docs, no_docs):
    table = sharding.lookup_table(tuple("abcdefg"), 251)
    assert set(table) == set(range(7)) and max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.lookup_table(tuple("abcdef"), 251)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 0.3 * 251
    rows = sharding.placed(odd_docs, "doc_id", tuple("abcdefg"), 251).collect()
    assert len(rows) == 13 and sharding.placements(no_docs).count() == 0
    for r in rows:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 251 and r.shard == table[r.slot]
