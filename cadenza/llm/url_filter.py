"""URL filter: rules first, then naive Bayes on segmented words.

Host labels such as ``cheappills`` are split into words by a unigram Viterbi search
over a word list counted from the pages' own text; host and path words are then scored
by multinomial naive Bayes with the classes block and allow.

Labels come from a short list of seed words (``SEEDS``), at a distance: a url with a seed
among its host words is an example for block, any other for allow, but the seeds
themselves are taken out of the examples they label, so the classifier learns what else
such urls look like (other host words, domains, path words). What a seed weighs comes
from the list alone: each is one more short text of the class block. So a url without any
seed is blocked if its words keep bad company, and a seed in good company may pass.

Both models are whole count tables over all pages and stay in the shared folder: the
substrings of the distinct hosts are joined to the words' counts, the tokens of distinct
hosts and paths to the tokens' counts. The driver gets their sums and the seeds' counts.

Defined cases: a null url, or one without ``://``, has empty host and path; it has no
words and the class with the larger prior; runs of letters of any length are split, and words
of any length counted; equal scores mean allow; the longest fitting
rule wins (host and path together), then the longer host, then the smaller string; a
null html has no words; an empty table gives an empty table; extra columns are ignored
except for page_id and url.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.session import materialize, small_side

BLOCK, ALLOW = "block", "allow"
#: Words whose presence in a host labels an example for block, and which are themselves texts of that class.
SEEDS = ("adult", "ads", "bets", "casino", "gambling", "pills", "poker", "porn", "sex", "spam", "track", "viagra", "xxx")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a task's counter before they go on to the shuffle.
_HELD = 200_000


def host_of(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end; A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Rules:
    """Rules (verdict, "host/path"): one fits its host and all subdomains, where the path starts with its path."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.lower(), []).append((slash + path, rule, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        best, name = None, host
        while name:
            for prefix, rule, verdict in self.by_host.get(name, ()):
                if path.startswith(prefix):
                    rank = (-len(rule), -len(name), rule)
                    if best is None or rank < best[0]:
                        best = rank, rule, verdict
            name = name.partition(".")[2]
        return best[1:] if best else None


class Segmenter:
    """Unigram Viterbi: the split of a letter run into words with the largest probability.

    counts need only hold the words that occur in the runs, if the total over all is given.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None) -> None:
        self.counts, self.lengths = counts, sorted({len(w) for w in counts if w})
        self.log_total = math.log(max(1, sum(counts.values()) if total is None else total))
        self.split = lru_cache(100_000)(self._split)

    def _cost(self, word: str) -> float:
        n = self.counts.get(word)
        # an unknown word is the less likely the longer it is
        return self.log_total - math.log(n) if n else self.log_total + math.log(10) * len(word)

    def _split(self, run: str) -> tuple[str, ...]:
        """Of equally likely splits that with the longer last word, and so on to the front.

        Two unknown words in a row are never likelier than one, so the best unknown word that
        ends at a place is a running minimum; known words have a few lengths. So a run of any
        length takes time in proportion.
        """
        unit, best, back = math.log(10), [0.0] * (len(run) + 1), [0] * (len(run) + 1)
        gap, gap_at = math.inf, 0
        for end in range(1, len(run) + 1):
            own = best[end - 1] - unit * (end - 1)
            if own < gap:
                gap, gap_at = own, end - 1
            cost, begin = gap + self.log_total + unit * end, gap_at
            for size in self.lengths:
                if size > end:
                    break
                n = self.counts.get(run[end - size : end])
                if n:
                    known = best[end - size] + self.log_total - math.log(n)
                    if known < cost or (known == cost and end - size < begin):
                        cost, begin = known, end - size
            best[end], back[end] = cost, begin
        out, end = [], len(run)
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return tuple(reversed(out))

    def host_words(self, host: str) -> list[str]:
        return [w for run in runs(host) for w in self.split(run)]


def runs(host: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", host)


def path_tokens(path: str) -> list[str]:
    """Path words, told from host words (h:) by their prefix; a number is one token."""
    return [f"p:{'0' if w.isdigit() else w}" for w in re.findall(r"\d+|[^\W\d_]+", path.lower())]


class NaiveBayes:
    """Multinomial, Laplace-smoothed over its own vocabulary; unknown tokens say nothing.

    counts (token, block, allow) is a table; examples per class, tokens per class and the
    vocabulary's size are sums over all of it.
    """

    def __init__(self, counts: DataFrame, docs: dict[str, int], smoothing: float = 1.0) -> None:
        classes = BLOCK, ALLOW
        sums = counts.agg(F.count("*").alias("size"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in classes]).first()
        total = sum(docs.values())
        prior = {c: math.log((docs.get(c, 0) + 1) / (total + 2)) for c in classes}
        mass = {c: math.log(sums[c] + smoothing * max(1, sums["size"])) for c in classes}
        self.prior = prior[BLOCK] - prior[ALLOW]
        weight = F.log(F.col(BLOCK) + smoothing) - F.log(F.col(ALLOW) + smoothing) - F.lit(mass[BLOCK] - mass[ALLOW])
        self.weights = counts.select("token", weight.alias("weight"))

    def scores(self, tokens: DataFrame) -> DataFrame:
        """tokens (key, token), a row per occurrence -> key, score: log odds of block without the prior.

        Weights are added in their order, so that the sum doesn't hang on the tasks.
        """
        known = tokens.join(small_side(self.weights), "token")
        return known.groupBy("key").agg(F.aggregate(F.array_sort(F.collect_list("weight")), F.lit(0.0), lambda a, w: a + w).alias("score"))


def _counted(rows: DataFrame, step, keys: int) -> DataFrame:
    """Sums of a task-side Counter over key tuples; the counter goes on when it is full."""
    names = [f"k{i}" for i in range(keys)]
    schema = pa.schema([(n, pa.string()) for n in names] + [("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            cols = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in cols], pa.array(list(held.values()), pa.int64())], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in zip(*[c.to_pylist() for c in batch.slice(at, 64).columns], strict=True):
                    step(held, *row)
                if len(held) > _HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return rows.mapInArrow(count, ", ".join(f"{n} string" for n in names) + ", n long").groupBy(*names).agg(F.sum("n").alias("n"))


def _parts(rows: DataFrame, parts, name: str) -> DataFrame:
    """rows (key, text) -> key and each of the text's parts; a long text isn't repeated beside them."""
    schema = pa.schema([("key", pa.string()), (name, pa.string())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for at, (key, text) in enumerate(zip(*[c.to_pylist() for c in batch.columns], strict=True), 1):
                own = parts(text)
                keys += [key] * len(own)
                found += own
                if len(found) > 10_000 or at == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], schema=schema)
                    keys, found = [], []

    return rows.mapInArrow(spread, f"key string, {name} string")


def page_words(pages: DataFrame) -> DataFrame:
    """Counts of all words of all pages' text, tags left out: word, n."""
    tag, word = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I), re.compile(r"[^\W\d_]+")

    def step(held: Counter, html: str | None) -> None:
        if html:
            held.update((w,) for w in word.findall(tag.sub(" ", html).lower()))

    return materialize(_counted(pages.select("html"), step, 1).withColumnRenamed("k0", "word"), "page-words")


def segment(hosts: DataFrame, counts: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """hosts (host), distinct, and counts (word, n) of all words -> host, words.

    Seed words count as a tenth of the most frequent word at least. A host's task gets the
    counts of just those words that are substrings of its runs: all substrings as long as
    some word are joined to the counts.
    """
    sums = counts.agg(F.max("n").alias("most"), F.sum("n").alias("total")).first()
    lengths = sorted(r.size for r in counts.select(F.char_length("word").alias("size")).distinct().collect())  # a row per length of a word
    own = {r.word: r.n for r in counts.filter(F.col("word").isin(*seeds)).collect()}
    raised = {w: max((sums.most or 1) // 10, own.get(w, 0), 1) for w in seeds}
    total = (sums.total or 0) + sum(n - own.get(w, 0) for w, n in raised.items())

    def pieces(host: str) -> list[str]:
        return list({run[i : i + size] for run in runs(host) for size in lengths for i in range(len(run) - size + 1)})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, known = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            words = [Segmenter({**{k["word"]: k["n"] for k in ks or ()}, **raised}, total).host_words(h) for h, ks in zip(hosts, known, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(words, pa.list_(pa.string()))], names=["host", "words"])

    keyed = hosts.select(F.md5("host").alias("key"), "host")
    known = _parts(keyed, pieces, "word").join(counts, "word").groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return materialize(keyed.join(known, "key", "left").select("host", "known").mapInArrow(split, "host string, words array<string>"), "host-words")


def train(urls: DataFrame, seeds: tuple[str, ...] = SEEDS) -> NaiveBayes:
    """urls (words of the host, path, n equal ones): counts of examples and tokens per class over all rows.

    Seeds label an example and are left out of it; each seed is a text of its own besides,
    which adds to the class's tokens but not to the number of examples.
    """
    known = frozenset(seeds)

    def step(held: Counter, words: list[str], path: str, n: int) -> None:
        label = BLOCK if known.intersection(words) else ALLOW
        held[label, ""] += n
        for token in [*[f"h:{w}" for w in words if w not in known], *path_tokens(path)]:
            held[label, token] += n

    counts = _counted(urls.select("words", "path", "n"), step, 2)
    listed = urls.sparkSession.createDataFrame([(BLOCK, f"h:{w}", 1) for w in seeds], "k0 string, k1 string, n long")
    split = [F.sum(F.when(F.col("k0") == c, F.col("n")).otherwise(0)).alias(c) for c in (BLOCK, ALLOW)]
    wide = materialize(counts.union(listed).groupBy(F.col("k1").alias("token")).agg(*split), "url-tokens")
    docs = wide.filter("token = ''").first()
    return NaiveBayes(wide.filter("token != ''"), {c: docs[c] for c in (BLOCK, ALLOW)} if docs else {})


def judge(pages: DataFrame, rules: list[tuple[str, str]], seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """pages (page_id, url, html) -> page_id, host, path, words, score, rule, verdict."""
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = materialize(urls.groupBy("host", "path").agg(F.count("*").alias("n")), "urls")
    hosts = segment(own.select("host").distinct(), page_words(pages), seeds)
    model = train(own.join(small_side(hosts), "host"), seeds)
    prior, table = model.prior, Rules(rules)

    of_hosts = model.scores(hosts.select(F.md5("host").alias("key"), F.explode(F.transform("words", lambda w: F.concat(F.lit("h:"), w))).alias("token")))
    of_paths = model.scores(_parts(own.select("path").distinct().select(F.md5("path"), "path"), path_tokens, "token"))
    sides = [
        materialize(hosts.join(of_hosts, F.md5("host") == F.col("key"), "left").select("host", "words", F.col("score").alias("of_host")), "host-scores"),
        materialize(of_paths.select(F.col("key").alias("path_key"), F.col("score").alias("of_path")), "path-scores"),
    ]
    rows = urls.join(small_side(sides[0]), "host", "left").withColumn("path_key", F.md5("path")).join(small_side(sides[1]), "path_key", "left")
    score = F.lit(prior) + F.coalesce("of_host", F.lit(0.0)) + F.coalesce("of_path", F.lit(0.0))
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("words", pa.list_(pa.string())), ("score", pa.float64()), ("rule", pa.string()), ("verdict", pa.string())])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, hosts, paths, _, scores = [c.to_pylist() for c in batch.columns]
            hits = [table.match(h, p) for h, p in zip(hosts, paths, strict=True)]
            verdicts = [hit[1] if hit else BLOCK if s > 0 else ALLOW for hit, s in zip(hits, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([hit and hit[0] for hit in hits], pa.string()), pa.array(verdicts, pa.string())], schema=schema)

    ddl = "page_id long, host string, path string, words array<string>, score double, rule string, verdict string"
    return rows.select("page_id", "host", "path", "words", score.alias("score")).mapInArrow(decide, ddl)
