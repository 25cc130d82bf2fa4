"""Keyword-stuffed and link-list pages, by bagged trees on weak labels and host-level smoothing.

Every page is read line by line: what share of its words stands in sentences, bare links, tags, lines
that repeat keywords, or lists, and how it is punctuated and wrapped. These are the content and link
features. Weak labels come from other cues, counted over the page as a whole: the rates of links,
hashtags, tags, of grammatical and of distinct words, of the most frequent word, and of code. Bagged
decision trees learn from a bounded sample of weakly labelled pages and score every page. Scores are
smoothed with the spam rate of the page's host (here the repository it belongs to), and the smoothed
score decides. Lines that tell nothing one by one are judged together, so wrapping a page does not
change its features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.scratch import cut

#: Documented bound of the weakly labelled rows on which the trees are fitted (every page is scored).
TRAIN_ROWS = 4_000
#: Trees and their depth.
TREES, DEPTH = 12, 5
#: Weight of the host's rate, and pages' worth of the global rate in it.
HOST_WEIGHT, HOST_PRIOR = 0.3, 20.0
#: Smoothed score from which a page is stuffed.
DECIDED = 0.5
#: Short lines from which they are a list of link texts.
LIST_LINES = 8
#: Copies of each host's rate in the join, against hosts that hold much of the corpus.
SALTS = 16

FEATURES = ("stuffed", "prose", "linked", "tagged", "repeating", "listed", "loose", "separators", "stops", "repeats", "short")
CUES = ("links", "hashtags", "tags", "top", "distinct", "grammar", "technical")

# Words that hold sentences together, by language; those common in names of things are left out.
_GRAMMAR = frozenset(
    (
        "the a an and to is it that with as was on are by this be from or not you have which but how does what why where who can when its into there their before after only between any if each every has had because until while my they them these without both since our we i "
        "le la les un une et est il elle qui que dans pour avec sur par ce cette ne plus au aux son sa ses nous vous je ou mais quand si sans chaque depuis été reste sont très fait avons car était y puis personne "
        "der die das und ist den von zu mit auf für nicht ein eine einen einem dem des im sich es als auch wird aus er hat dass sie nach bei um am wie ich wir wenn ohne jeder jede bis zur zum kann bleibt wir haben niemand diese "
        "el los las una y es por con para se al lo su sus como este esta hay ya muy sin cada cuando hasta porque está son sobre hemos si creo nadie"
    ).split()
)
_TOKEN = re.compile(r"https?://[^\s<>\"')\]]+|#?[^\W_][\w'’-]*")
_LINK = re.compile(r"https?://")
_TAG = re.compile(r"\btag:|\bsku-\d|^tags?:", re.I)
_MARKUP = re.compile(r"</?[a-z][^>]*?(?:href=[\"']?([^\"'>\s]*)[\"']?)?[^>]*>", re.I)
_CODE = re.compile(r"[{};]\s*$|=>|:=|==|\w\(.*\)|^\s*[+-]{3}|^\s*(?:def|func|class|return|import|const|let|if|for)\b|`")
_LOG = re.compile(r"\b\d{1,2}:\d{2}(?::\d{2})?\b|\b(?:DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE)\b")
_DRAWN = re.compile(r"[│├└┌┐┘─═║╔╗╚╝▼▲►◄]|[-=]{2,}>|<[-=]{2,}|\+-{2,}|^\s*\|.*\|\s*$")
_SEPARATOR = re.compile(r"[,;|]|>>")


class _Loose:
    """The lines of a page that are no sentence, code, log or diagram, but tell nothing one by one."""

    def __init__(self) -> None:
        self.n = self.hold = self.lines = self.ended = self.short = 0
        self.words: dict[str, int] = {}

    def add(self, line: str, n: int, plain: list[str], hold: int) -> None:
        if _CODE.search(line) or not any(c.isalpha() for c in line):
            return
        self.n += n
        self.hold += hold
        self.lines += 1
        self.ended += line.endswith((".", "!", "?", ":"))
        self.short += n < 6
        for t in plain:
            self.words[t] = self.words.get(t, 0) + 1

    def stuffed(self) -> bool:
        """True if all of them together repeat words as a stuffed line does, or are a list of link texts."""
        if self.n < 6 or self.hold >= 0.06 * self.n or self.ended * 2 > self.lines:
            return False
        again = sum(self.words.values()) - len(self.words)
        return again >= 0.25 * self.n or self.lines >= LIST_LINES and self.short >= 0.9 * self.lines and self.ended <= 0.1 * self.lines


def page_features(text: str) -> tuple[list[float], list[float], int]:
    """(features, cues, words) of a page; all but the last are shares of its words."""
    words = links = hashtags = tags = separators = stops = grammar = repeats = 0
    prose = technical = linked = tagged_words = repeating = short = 0
    counts: dict[str, int] = {}
    loose = _Loose()
    fence = False
    for line in text.splitlines():
        line = line.strip()
        if line.startswith(("```", "~~~")):
            fence = not fence
            continue
        if not line:
            continue
        if "<" in line:
            line = _MARKUP.sub(lambda m: f" {m.group(1)} " if m.group(1) else " ", line)
        tokens = _TOKEN.findall(line)
        n = len(tokens)
        if not n:
            continue
        words += n
        if fence:
            technical += n
            continue
        urls = line.count("http://") + line.count("https://")
        plain = [t.lower() for t in tokens if not t.startswith("http")]
        hold = sum(t in _GRAMMAR for t in plain)
        hashed = sum(t[0] == "#" for t in plain)
        tagged = len(_TAG.findall(line)) if ":" in line or "-" in line else 0
        marks = len(_SEPARATOR.findall(line))
        for t in plain:
            counts[t] = counts.get(t, 0) + 1
        links += urls
        hashtags += hashed
        tags += tagged
        separators += marks
        grammar += hold
        stops += line.count(". ") + line.endswith((".", "!", "?"))
        again = len(plain) - len(set(plain))
        repeats += again
        short += n * (n < 6)
        held = hold >= 0.12 * max(1, len(plain))
        bare = urls > 0 and (hold == 0 if len(plain) < 16 and urls == 1 else hold < 0.1 * len(plain))
        if bare:
            linked += n
        elif hashed * 2 >= n and hashed >= 3 or tagged and not held:
            tagged_words += n
        elif held or line[0] == "#" and line[1:2] in " #":
            prose += n
        elif _LOG.search(line) or _DRAWN.search(line):
            technical += n
        elif n < 6:
            loose.add(line, n, plain, hold)
        elif again >= 0.25 * len(plain) and hold < 0.06 * len(plain) and not (marks < 3 and _CODE.search(line)):
            repeating += n
        elif marks >= 5 and hold < 0.04 * len(plain) and not _CODE.search(line):
            repeating += n
        else:
            loose.add(line, n, plain, hold)
    # repetition and lists are the same whether a page is wrapped or not
    listed = loose.n if loose.stuffed() else 0
    w = max(1, words)
    technical += max(0, words - prose - technical - linked - tagged_words - repeating - loose.n)  # lines of code, numbers and signs
    stuffed = linked + tagged_words + repeating + listed
    features = [stuffed, prose, linked, tagged_words, repeating, listed, loose.n - listed, separators, stops, repeats, short]
    cues = [links, hashtags, tags, max(counts.values(), default=0), len(counts), grammar, technical]
    return [x / w for x in features], [x / w for x in cues], words


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [page_features(t) for t in pdf["text"]]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "host": pdf["host"], "features": [r[0] for r in rows], "cues": [r[1] for r in rows], "n_words": [r[2] for r in rows]})


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, host, features, n_words, weak, clear): a row for each page with text; weak is null if unsure.

    A page is weakly spam if two cues agree and hardly a word is grammatical, weakly sound if at most one
    cue speaks and it is made of grammatical words or code. ``clear`` is false where one cue or the stuffed
    share of its words disagrees; such pages are rare and show the trees where to draw the line.
    """
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("repo_id").cast("string"), F.lit("")).alias("host"), "text")
    source = source.filter("doc_id is not null and text is not null")
    rows = source.mapInPandas(_measure, "doc_id long, host string, features array<double>, cues array<double>, n_words long")
    c = dict(zip(CUES, (F.col("cues")[i] for i in range(len(CUES)))))
    said = (c["links"] > 0.12).cast("int") + (c["hashtags"] > 0.2).cast("int") + (c["tags"] > 0.1).cast("int") + (c["top"] > 0.15).cast("int") + ((c["distinct"] < 0.4) & (c["technical"] < 0.5)).cast("int")
    sure = F.when((said >= 2) & (c["grammar"] < 0.08) & (c["technical"] < 0.4), 1.0).when((said <= 1) & ((c["grammar"] > 0.15) | (c["technical"] > 0.5)), 0.0)
    return rows.select("doc_id", "host", "features", "n_words", sure.alias("weak"), ((said >= 2) | (said == 0) & (F.col("features")[0] == 0)).alias("clear"))


def scored(documents: DataFrame, *, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, n_words, score, smoothed): the trees' score and the one smoothed by host.

    A null repo_id is a host of its own. Null texts are no pages; empty ones have no words and score
    like any other. Without weak labels of both kinds the stuffed share itself is the score. An empty
    table gives an empty result. Other columns are ignored; repeated rows give repeated rows.
    """
    pages = cut(measured(documents), "pages")
    known = pages.filter("weak is not null")
    per = {(r["weak"], r["clear"]): r["count"] for r in known.groupBy("weak", "clear").count().collect()}  # three rows at most
    if len({weak for weak, _ in per}) == 2:
        # a repeatable sample by hash: half of each kind, of the sound ones half such as a cue speaks against
        part = None
        for (weak, clear), n in per.items():
            most = train_rows // (2 if weak else 4)
            share = int(1_000_000 * min(1.0, 1.2 * most / n)) + 1
            one = known.filter((F.col("weak") == weak) & (F.col("clear") == clear) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)).limit(most)
            part = one if part is None else part.unionByName(one)
        train = part.select(array_to_vector("features").alias("x"), F.col("weak").alias("label")).coalesce(2).cache()
        trees = RandomForestClassifier(
            featuresCol="x", numTrees=TREES, maxDepth=DEPTH, maxBins=32, featureSubsetStrategy="all", subsamplingRate=0.7, seed=7
        ).fit(train)
        train.unpersist()
        trees.setFeaturesCol("x").setProbabilityCol("p").setRawPredictionCol("").setPredictionCol("")
        seen = trees.transform(pages.withColumn("x", array_to_vector("features"))).withColumn("score", vector_to_array("p")[1])
    else:
        seen = pages.withColumn("score", F.col("features")[0])
    seen = cut(seen.select("doc_id", "host", "n_words", "score"), "scores")
    hosts = seen.groupBy("host").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    total = seen.agg(F.avg("score")).first()[0]
    if total is None:
        return seen.select("doc_id", "n_words", "score", F.col("score").alias("smoothed"))

    def logit(x):
        x = F.least(F.greatest(x, F.lit(1e-4)), F.lit(1 - 1e-4))
        return F.log(x / (1 - x))

    rate = hosts.select("host", ((F.col("s") + HOST_PRIOR * total) / (F.col("n") + HOST_PRIOR)).alias("rate"))
    rate = rate.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = seen.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    shifted = logit(F.col("score")) + HOST_WEIGHT * (logit(F.col("rate")) - logit(F.lit(total)))
    return salted.join(rate, ["host", "salt"]).select("doc_id", "n_words", "score", (1 / (1 + F.exp(-shifted))).alias("smoothed"))


def stuffed_pages(documents: DataFrame) -> DataFrame:
    """(doc_id): the pages with words whose smoothed score reaches ``DECIDED``."""
    return scored(documents).filter((F.col("smoothed") >= DECIDED) & (F.col("n_words") > 0)).select("doc_id").distinct()
