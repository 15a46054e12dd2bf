"""Alignment of long lists, marks that differ on every page, deep elements, and parts of many tasks."""

import random
import time

from pageframe.llm import warc, wrapper


def longest(x, y):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_matches_are_a_longest_common_order(monkeypatch):
    rng = random.Random(1)
    for table in (250_000, 12):
        monkeypatch.setattr(wrapper, "TABLE", table)
        monkeypatch.setattr(wrapper, "STRETCH", 3)
        for _ in range(400):
            letters = rng.choice(("ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz"))
            x, y = (rng.choices(letters, k=rng.randint(0, 14)) for _ in range(2))
            got = wrapper.matches(x, y)
            assert all(x[i] == y[j] for i, j in got) and all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:], strict=False))
            assert len(got) == longest(x, y) or table == 12


def page(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=9))
    return "<html><body><div class=top>menu</div>" + "".join(f'<div class="post {word()}"><p>{word()}</p></div>' for _ in range(n)) + "</body></html>"


def test_marks_of_their_own_take_time_in_proportion():
    began = time.time()
    whole = None
    for seed in range(30):
        one = wrapper.form(wrapper.tree(page(300, seed)))
        whole = wrapper.merged(whole, one) if whole else one
    assert time.time() - began < 60
    assert len(wrapper.json.dumps(whole)) < 20_000
    assert ".*" in wrapper.json.dumps(whole)


def test_one_wrapper_of_many_parts(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.org/{i}", f"<body><article><p>text {i}</p></article><footer>f</footer></body>") for i in range(40)], "page_id long, url string, html string").repartition(20)
    for fan_in in (2, 64):
        found = wrapper.wrappers(pages, fan_in).collect()
        assert sorted((r.host, r.n_pages) for r in found) == [("h0.org", 20), ("h1.org", 20)]
        assert len({r.wrapper for r in found}) == 1


def test_deep_elements_stay_set_aside(spark):
    deep = "<div>" * 450
    html = f"<body>{deep}<nav><div><b>menu</b></div>more menu</nav><p>said</p><nav>again</nav>{'</div>' * 450}<p>after</p></body>"
    rows = spark.createDataFrame([(1, "http://a.org/", html)], "page_id long, url string, html string")
    assert wrapper.extracted(rows).first().text == "said\nafter"


def test_dictionary_of_large_records():
    rng = random.Random(3)
    records = [b"HEAD " * 50 + rng.randbytes(1 << 21) for _ in range(3)]
    data = warc.packed(records)
    assert list(warc.unpacked(data)) == records
    assert len(warc.dictionary(records).as_bytes()) > 1000
