"""URL filter: rules first, then naive Bayes over segmented host and path tokens.

Rules name a host and a path; they hold for the host and its subdomains, and for paths that
begin with theirs, and the longest that fits decides. Where none fits, the method does:

1. A unigram model counts the words of the pages' visible text, over all pages.
2. Host labels and path pieces are runs of letters. Viterbi splits each into the words that
   make it likeliest under the unigram model; letters no word covers have a price and stay together.
3. Tokens (host words, path words, kinds of numbers) are counted, each by itself, over all URLs
   that a rule decides, allowed and blocked. Multinomial naive Bayes adds up the log ratios of
   a URL's tokens; a positive sum blocks it. A token that no ruled URL has says nothing.

Only the `VOCABULARY` words are sent to the tasks; tokens meet their weights in an equi-join, so
their number has no bound. Weights are whole multiples of 1/`UNIT`, so that sums do not depend on
the order of their parts. A host is segmented once per task, however many of its pages the task has.

Defined cases: a null url or one without `://` has empty host and path, fits no rule and has
no tokens, so the prior decides; null html has no words; a tag, comment or
script that is never closed is text; where the rules decide no URL, or
only one way, the method allows, or decides that way; repeated rows are judged alike; an empty
table gives no rows. Columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulbook.llm.common import arrow_map
from haulbook.session import materialize

#: (verdict, host, path) of the rules.
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
VOCABULARY = 50_000
#: Steps in which the vocabulary is cut, to a doubling of frequency.
LEVELS = 64
#: Word lengths that the segmentation considers.
SHORTEST, LONGEST = 2, 16
SMOOTHING = 0.5
#: Steps of a weight.
UNIT = 1 << 32

#: What begins a tag, and what ends each kind; a kind without its end is a plain tag.
_OPEN = re.compile(r"(?i)<(?:(script)|(style)|(!--))?")
_CLOSE = (re.compile(">"), re.compile(r"(?i)</script\s*>"), re.compile(r"(?i)</style\s*>"), re.compile("-->"))
_ZEROS, _NO_LETTER = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[1-9][0-9]{7,};?")
_WORD = re.compile(r"[^\W\d_]{%d,%d}" % (SHORTEST, LONGEST))
_PIECE = re.compile(r"[^\W\d_]+|\d+")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path, both empty without `://`."""
    url = F.coalesce(url, F.lit(""))
    after = F.substr(url, F.locate("://", url) + F.lit(3))
    rest = F.when(F.locate("://", url) > 0, after).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"\A[^?#]*", 0)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def without_tags(html: str) -> str:
    """The text with a space for each tag, comment, script and style.

    An end that is not found once is not looked for again, so the work is linear in the text.
    """
    out, at, missing = [], 0, set()
    begin = _OPEN.search(html)
    while begin:
        end = None
        for kind in (begin.lastindex or 0, 0):
            if end is None and kind not in missing:
                end = _CLOSE[kind].search(html, begin.end() if kind else begin.start() + 1)
                if end is None:
                    missing.add(kind)
        if end is None:
            if 0 in missing:  # the other ends have a > too
                break
            begin = _OPEN.search(html, begin.start() + 1)
            continue
        out += [html[at:begin.start()], " "]
        at = end.end()
        begin = _OPEN.search(html, at)
    return "".join(out) + html[at:]


def visible_words(html: str | None) -> list[str]:
    """Words of the text; references to numbers beyond all letters, of any length, are no letters."""
    if not html:
        return []
    text = _NO_LETTER.sub("\ufffd", _ZEROS.sub("&#", without_tags(html)))
    return _WORD.findall(entities.unescape(text).lower())


def unigrams(pages: DataFrame, most: int = VOCABULARY) -> dict[str, int]:
    """The commonest words of all pages' visible text, at most `most`, counted in tasks before
    the shuffle."""

    def work(batches):
        counts = Counter()
        for batch in batches:
            for html in batch.column("html").to_pylist():
                counts.update(visible_words(html))
            if len(counts) > 500_000:
                yield {"word": list(counts), "times": list(counts.values())}
                counts = Counter()
        yield {"word": list(counts), "times": list(counts.values())}

    counted = arrow_map(pages.select("html"), work, "word string, times long").groupBy("word").agg(F.sum("times").alias("times"))
    counted = materialize(counted.withColumn("level", F.floor(F.log2("times") * LEVELS).cast("int")), "url-words")
    # Whole levels of frequency, from the top, as long as they fit: few rows reach the driver.
    least, held = None, 0
    for r in counted.groupBy("level").agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        held += r.words
        if held > most:
            break
        least = r.level
    if least is None:
        return {}
    return {r.word: r.times for r in counted.where(F.col("level") >= least).collect()}


class Segmenter:
    """Unigram Viterbi over the letters of a name."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        self.unknown = math.log(total) + math.log(26)  # per letter that no word covers
        self.known: dict[str, list[str]] = {}

    def __call__(self, name: str) -> list[str]:
        if name in self.known:
            return self.known[name]
        best, cut = [0.0], [0]
        for end in range(1, len(name) + 1):
            cost, at = best[end - 1] + self.unknown, end - 1
            for start in range(max(end - LONGEST, 0), end - SHORTEST + 1):
                word = self.cost.get(name[start:end])
                if word is not None and best[start] + word < cost:
                    cost, at = best[start] + word, start
            best.append(cost)
            cut.append(at)
        words, end, loose = [], len(name), False
        while end:
            word = name[cut[end]:end]
            unknown = word not in self.cost
            if unknown and loose:
                words[-1] = word + words[-1]
            else:
                words.append(word)
            end, loose = cut[end], unknown
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[name] = words[::-1]
        return self.known[name]


def tokens(host: str, path: str, segment: Segmenter) -> list[str]:
    """Host words, path words and path numbers by their length and first digit."""
    out = []
    for kind, text in (("h", host), ("p", path)):
        for piece in _PIECE.findall(text.lower()):
            if piece[0].isdigit():
                out.append(f"{kind}#{len(piece)}{piece[0]}")
            else:
                out += [f"{kind}:{w}" for w in segment(piece)]
    return out


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))


def with_tokens(ruled: DataFrame, segment: Segmenter) -> DataFrame:
    """The judged pages with their tokens."""

    def work(batches):
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("page_id", "host", "path", "rule", "ruled")}
            yield {**columns, "tokens": [tokens(h, p, segment) for h, p in zip(columns["host"], columns["path"])]}

    return arrow_map(ruled, work, "page_id long, host string, path string, rule string, ruled string, tokens array<string>")


def bayes(ruled: DataFrame) -> tuple[float, DataFrame]:
    """Prior, and a table of token weights in steps of 1/`UNIT`, both positive towards blocking,
    from the URLs that rules decide."""
    blocks = (F.col("ruled") == "block").cast("long")
    ruled = ruled.where("ruled is not null")
    urls = ruled.agg(F.count("*").alias("all"), F.coalesce(F.sum(blocks), F.lit(0)).alias("block")).first()
    counted = (
        ruled.select(blocks.alias("block"), F.explode("tokens").alias("token"))
        .groupBy("token").agg(F.count("*").alias("all"), F.sum("block").alias("block"))
    )
    counted = materialize(counted, "url-tokens-counted")
    sums = counted.agg(F.count("*").alias("seen"), F.sum("all").alias("all"), F.sum("block").alias("block")).first()
    if not 0 < urls["block"] < urls["all"] or not sums["seen"]:
        prior = math.log((urls["block"] + SMOOTHING) / (urls["all"] - urls["block"] + SMOOTHING)) if urls["all"] else -1.0
        return prior, counted.select("token", F.lit(0).cast("long").alias("weight")).where("false")
    share = lambda times, total: (times + SMOOTHING) / (total + SMOOTHING * sums["seen"])
    ratio = share(F.col("block"), sums["block"]) / share(F.col("all") - F.col("block"), sums["all"] - sums["block"])
    return (
        math.log(urls["block"] / (urls["all"] - urls["block"])),
        counted.select("token", F.round(F.log(ratio) * UNIT).cast("long").alias("weight")),
    )


def verdicts(pages: DataFrame, rules=RULES, vocabulary: int = VOCABULARY) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and the method's score and host words."""
    segment = Segmenter(unigrams(pages, vocabulary))
    rows = with_tokens(judged(pages, rules), segment).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "url-tokens")
    prior, weights = bayes(rows)
    sums = (
        rows.select("row", F.explode("tokens").alias("token")).join(weights, "token")
        .groupBy("row").agg(F.sum("weight").alias("sum"))
    )
    score = F.lit(prior) + F.coalesce(F.col("sum"), F.lit(0)) / F.lit(float(UNIT))
    hosts = F.transform(F.filter("tokens", lambda t: F.startswith(t, F.lit("h:"))), lambda t: F.substring(t, 3, 1 << 30))
    return rows.join(sums, "row", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(score > 0, "block").otherwise("allow")).alias("verdict"),
        score.alias("score"), hosts.alias("host_words"),
    )
