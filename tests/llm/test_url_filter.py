import itertools
import math
from collections import Counter

from cadenza.llm import catalog, url_filter
from cadenza.llm.url_filter import ALLOW, BLOCK, Rules, Segmenter


def test_host_and_path(spark):
    urls = ["http://A.Example.com/en/7?x#y", "https://h?q/a", "x", None, "a://b://c", "http://h#f/p", "ü://É.org/p/?", "://"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [(r.h, r.p) for r in df.select(url_filter.host_of(df.url).alias("h"), url_filter.path_of(df.url).alias("p")).collect()]
    assert got == [("a.example.com", "/en/7"), ("h", ""), ("", ""), ("", ""), ("b:", "//c"), ("h", ""), ("É.org", "/p/"), ("", "")]


def test_rules():
    r = Rules(catalog.URL_RULES)
    assert r.match("a.example.com", "/en/7") == ("example.com/en/7", ALLOW)
    assert r.match("example.com", "/en/8") == ("com/en/", BLOCK)
    assert r.match("notexample.com", "/en/7") == ("com/en/", BLOCK)
    assert r.match("x.example.net", "/de/81") == ("example.net/de/8", BLOCK)
    assert r.match("net", "/de/") == ("net/de/", ALLOW)
    assert r.match("a.org", "/en/") is None and r.match("", "") is None


def test_viterbi_is_the_best_split():
    counts = {"cheap": 50, "pills": 40, "che": 30, "ap": 30, "pill": 5, "s": 5, "a": 9}
    seg = Segmenter(counts)
    for run in ("cheappills", "apche", "zzcheap", "spills"):
        splits = []
        for cuts in itertools.product([0, 1], repeat=len(run) - 1):
            words, begin = [], 0
            for k, c in enumerate([*cuts, 1], 1):
                if c:
                    words.append(run[begin:k])
                    begin = k
            splits.append((sum(seg._cost(w) for w in words), words))
        assert math.isclose(sum(seg._cost(w) for w in seg.split(run)), min(splits)[0])
    assert seg.split("cheappills") == ("cheap", "pills")


def test_judge(spark):
    good = [(i, f"http://garden{i % 3}.org/en/{i}", "<p>garden house cheap pills</p>", "x") for i in range(60)]
    bad = [(100 + i, f"http://cheappills{i}.org/buy/{i}", "<p>cheap pills</p>", "x") for i in range(20)]
    odd = [(200, None, None, "x"), (None, "nothing", "<p>", "x"), (201, "http://host.org/" + "long" * 5000, None, "x"), (202, "http://buycheap.org/buy/3", "", "x"), (1, good[1][1], "", "x")]
    pages = spark.createDataFrame(good + bad + odd, "page_id long, url string, html string, verdict string")
    out = {r.page_id: r for r in url_filter.judge(pages, catalog.URL_RULES).collect()}
    assert all(out[i].verdict == ALLOW for i in range(60)) and all(out[100 + i].verdict == BLOCK for i in range(20))
    assert out[200].host == "" and out[200].path == "" and out[200].rule is None and out[202].verdict == BLOCK
    assert url_filter.judge(pages, []).count() == len(good + bad + odd)
    assert url_filter.judge(pages.limit(0), catalog.URL_RULES).count() == 0


def test_on_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = Rules(catalog.URL_RULES)
    out = catalog.op2_url_filter(spark, sf_dir).collect()
    assert len(out) == pages.count()
    for r in out:
        hit = rules.match(r.host, r.path)
        assert (r.rule, r.verdict if hit else None) == (hit or (None, None))


def brute_scores(urls, seeds=url_filter.SEEDS):
    """urls [(words, path tokens)] -> log odds, by counting in plain Python."""
    token, docs = {BLOCK: Counter(f"h:{w}" for w in seeds), ALLOW: Counter()}, Counter()
    for words, path in urls:
        label = BLOCK if set(words) & set(seeds) else ALLOW
        docs[label] += 1
        token[label].update([*[f"h:{w}" for w in words if w not in seeds], *path])
    size = len({*token[BLOCK], *token[ALLOW]})

    def log_odds(tokens):
        out = math.log((docs[BLOCK] + 1) / (docs[ALLOW] + 1))
        for t in tokens:
            if t in token[BLOCK] or t in token[ALLOW]:
                out += math.log((token[BLOCK][t] + 1) / (sum(token[BLOCK].values()) + size)) - math.log((token[ALLOW][t] + 1) / (sum(token[ALLOW].values()) + size))
        return out

    return [log_odds([*[f"h:{w}" for w in words], *path]) for words, path in urls]


def test_scores_and_verdicts_against_brute_force(spark, sf_dir):
    out = url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), []).collect()
    want = brute_scores([(r.words or [], url_filter.path_tokens(r.path)) for r in out])
    assert all(math.isclose(r.score, w, rel_tol=1e-9, abs_tol=1e-9) and r.verdict == (BLOCK if w > 0 else ALLOW) for r, w in zip(out, want, strict=True))


def test_verdicts_are_not_the_seed_list(spark):
    """Hosts without a seed are blocked by the company their words keep, and a seed in good company passes."""
    text = "lucky jackpot win garden house tree news book casino"
    bad = [(i, f"http://{w}{s}.bad/win/{i}", text) for i, (w, s) in enumerate(itertools.product(("lucky", "jackpot", "win"), ("casino", "poker", "bets")))] * 12
    good = [(100 + i, f"http://{w}{v}.org/read/{i}", text) for i, (w, v) in enumerate(itertools.product(("garden", "house", "tree", "news", "book"), repeat=2))] * 40
    new = [(1000, "http://luckyjackpot.bad/win/1", text), (1001, "http://gardentreehousenewsbookcasino.org/read/1", text), (1002, "http://housebook.org/read/5", text)]
    out = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(bad + good + new, "page_id long, url string, html string"), []).collect()}
    assert out[1000].words == ["lucky", "jackpot", "bad"] and out[1000].verdict == BLOCK
    assert "casino" in out[1001].words and out[1001].verdict == ALLOW
    assert out[1002].verdict == ALLOW and all(out[i].verdict == BLOCK for i, _, _ in bad) and all(out[i].verdict == ALLOW for i, _, _ in good)


def test_runs_beyond_a_host_label_are_split(spark):
    """A run of 80 letters and one of 63 are treated alike, and so is a word of 70."""
    long = "regenbogen" * 7
    rows = [(0, f"http://{'gardenhouse' * 7}xyz.org/", f"garden house {long}"), (1, f"http://my{long}garden.org/", "my garden house")]
    out = {r.page_id: r.words for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), []).collect()}
    assert out[0] == ["garden", "house"] * 7 + ["xyz", "org"] and out[1] == ["my", long, "garden", "org"]


def test_long_words_and_runs(spark):
    word, run = "donau" * 6, "ab" * 40
    rows = [(0, f"http://my{word}garden.org/", f"<p>my {word} garden {'x' * 5000}</p>"), (1, f"http://{run}.org/", run), (2, "http://" + "y" * 30_000 + ".org/", "")]
    out = {r.page_id: r.words for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), []).collect()}
    assert out[0] == ["my", word, "garden", "org"] and out[1] == [run, "org"] and out[2][0] == "y" * 30_000


def test_rare_words_count(spark):
    """More than 50,000 more frequent words and tokens leave the rare ones in the models."""
    letters = "abcdefghijklmnop"
    many = ["zz" + "".join(letters[n >> s & 15] for s in (0, 4, 8, 12)) for n in range(50_100)]
    rows = [(0, "http://plain.org/" + "/".join(many * 2), " ".join(many * 2)), (1, "http://quiltpills.org/", "<p>quilt zebra</p>"), (2, "http://zebraquilt.org/x", ""), (3, "http://quiltpills.org/x", None)]
    out = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), []).collect()}
    assert out[2].words == ["zebra", "quilt", "org"] and out[1].words == ["quilt", "pills", "org"]
    assert out[0].words == ["plain", "org"]
    urls = [(out[i].words, url_filter.path_tokens(out[i].path)) for i in range(4)]
    for page, want in enumerate(brute_scores(urls)):
        assert math.isclose(out[page].score, want, rel_tol=1e-9)
    assert [out[i].verdict for i in (1, 2, 3)] == [BLOCK, BLOCK, BLOCK] and out[0].verdict == ALLOW
