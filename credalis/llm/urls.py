"""URL verdicts: listed rules first, then logistic regression on hashed character n-grams of host and path.

Everything that touches pages is a column expression. The model is fitted on the small labelled table below, in plain
Python on the driver; its weights are whole numbers in an array literal, so a verdict is an exact sum.
"""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credalis.llm.skew import joined
from credalis.llm.store import table

BUCKETS = 4096
SIZES = (3, 4)
SCALE = 1_000_000
#: Up to so many rules are compared as one expression; more are joined as a table, with the same results.
INLINE_RULES = 200

#: The small labelled table: hosts and paths, invented.
ALLOW = """docs.example.org/guide/start blog.example.net/2021/05/notes news.example.com/world/article-1234 www.example.edu/research/papers wiki.example.org/wiki/history
recipes.example.com/bread/sourdough library.example.gov/catalog/item museum.example.org/exhibits/2020 forum.example.net/thread/4411 learn.example.edu/course/algebra
science.example.com/en/12345.html weather.example.org/fr/7788 travel.example.net/de/9911/ health.example.gov/es/page2 maps.example.com/city/park
code.example.org/project/readme m.example.com/en/5512 garden.example.net/plants/roses music.example.org/scores/bach www.example.com/about
open.example.edu/lectures/week-3 history.example.net/en/31310.html press.example.gov/releases/may kids.example.org/stories/fox data.example.com/tables/census
journal.example.org/volume/12 city.example.gov/council/minutes books.example.net/review/99 cooking.example.com/fr/soupe birds.example.org/de/1234""".split()
BLOCK = """casino.example.com/bonus/free-spins xxx.example.net/video/hot pills.example.org/buy-cheap-viagra bet.example.com/poker/win-cash adult.example.net/cam/live
free-crack.example.org/download/keygen warez.example.com/serial/full-crack porn.example.net/xxx/tube loans.example.org/fast-cash-now slots.example.com/jackpot
hotgirls.example.net/dating/sex replica.example.org/cheap-watches clickbait.example.com/you-wont-believe torrent.example.net/movie/free-download phish.example.org/verify-account-login
lottery.example.com/winner/claim-prize escort.example.net/city/sex casino-online.example.org/roulette xxxtube.example.com/porn/1 pharma.example.net/pills/cialis
bet-win.example.org/slots/bonus spam.example.com/click/aff?id=1 nude.example.net/gallery/xxx keygen.example.org/crack/serial poker.example.com/free-bonus
cheap-pills.example.net/order gambling.example.org/casino sexcam.example.com/live/adult malware.example.net/setup.exe winner.example.org/claim-cash-prize""".split()


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Of the query.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def split_url(url: str | None) -> tuple[str, str]:
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def buckets(host: str, path: str) -> list[int]:
    """The n-gram buckets of ``^host$path$``; characters count as their code points."""
    s = [ord(c) for c in f"^{host}${path}$"]
    return [(sum(s[i + j] * 31**j for j in range(n)) + 7 * n) % BUCKETS for n in SIZES for i in range(len(s) - n + 1)]


@functools.cache
def fitted(rounds: int = 300, rate: float = 4.0, ridge: float = 1e-3) -> tuple[tuple[int, ...], int]:
    """(weights, offset) in units of 1 / SCALE: logistic regression of block on the mean of a URL's bucket weights."""
    rows = []
    for y, urls in ((0, ALLOW), (1, BLOCK)):
        for u in urls:
            b = buckets(*split_url(f"https://{u}"))
            share: dict[int, float] = {}
            for x in b:
                share[x] = share.get(x, 0.0) + len(b) ** -0.5
            rows.append((share, len(b) ** 0.5, y))
    w, offset = [0.0] * BUCKETS, 0.0
    for _ in range(rounds):
        for share, _, y in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, offset + sum(w[k] * v for k, v in share.items())))))
            step = rate / len(rows) * (y - p)
            offset += step
            for k, v in share.items():
                w[k] += step * v - rate / len(rows) * ridge * w[k]
    return tuple(round(x * SCALE) for x in w), round(offset * SCALE)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def blocked_by_model(host: Column, path: Column) -> Column:
    """Whether the model blocks: offset * sqrt(n) + sum of weights > 0, so that a URL's length doesn't decide."""
    weights, offset = fitted()
    signs = F.transform(F.regexp_extract_all(F.concat(F.lit("^"), host, F.lit("$"), path, F.lit("$")), F.lit("(?s)."), F.lit(0)), F.ascii)
    table_ = F.array(*[F.lit(x) for x in weights])
    total: Column = F.lit(0).cast("long")
    count: Column = F.lit(0)

    def adding(n: int):
        def one(acc: Column, i: Column) -> Column:
            code = F.lit(7 * n).cast("long")
            for j in range(n):
                code = code + F.element_at(signs, i + j) * F.lit(31**j).cast("long")
            return acc + F.element_at(table_, (F.pmod(code, F.lit(BUCKETS)) + 1).cast("int"))

        return one

    for n in SIZES:
        grams = F.greatest(F.size(signs) - n + 1, F.lit(0))
        places = F.when(grams > 0, F.sequence(F.lit(1), F.greatest(grams, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        total = total + F.aggregate(places, F.lit(0).cast("long"), adding(n))
        count = count + grams
    return total + F.lit(offset) * F.sqrt(count.cast("double")) > 0


def _inline(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text, r.verdict)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def judge(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (text of the longest rule that fits, else null) and ``verdict`` added; columns of
    these names are replaced, others are carried and not read.

    A rule fits its host and all subdomains where the URL's path starts with the rule's; of equally long rules the one whose
    text, then verdict, sorts last wins. ``rules`` may be a table (verdict, host, path) of any size, then matched by a join on
    host suffixes; rules with a null don't count. A null URL or one without ``://`` has an empty host and path and gets the
    model's verdict. Each row stands for itself, so repeated rows repeat their result; an empty table gives an empty one.
    """
    address = pages[url]
    out = pages.withColumns({"host": host_of(address), "path": path_of(address)})
    if isinstance(rules, tuple) and len(rules) <= INLINE_RULES:
        text, listed = _inline(F.col("host"), F.col("path"), rules)
    else:
        if isinstance(rules, tuple):
            rules = pages.sparkSession.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
        labels = F.split("h", r"\.")
        every = out.select(F.col("host").alias("h"), F.col("path").alias("p")).distinct()
        every = every.withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
        # the rules of one host are one row, and most URLs may have the same suffix
        own = rules.dropna(subset=["verdict", "host", "path"]).groupBy(F.col("host").alias("suffix")).agg(F.collect_set(F.struct(F.col("path").alias("rp"), F.col("verdict").alias("rv"))).alias("own"))
        own = own.join(every.groupBy("suffix").agg(F.count(F.lit(1)).alias("rows")), "suffix")
        met = joined(every, own, ["suffix"], "rows", ["h", "p"])
        fits = F.filter("own", lambda r: F.startswith(F.col("p"), r["rp"]))
        met = met.select("h", "p", F.array_max(F.transform(fits, lambda r: F.struct((F.length("suffix") + F.length(r["rp"])).alias("n"), F.concat(F.col("suffix"), r["rp"]).alias("rule"), r["rv"].alias("verdict")))).alias("best"))
        best = met.filter("best is not null").groupBy("h", "p").agg(F.max("best").alias("_best"))
        out = out.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").drop("h", "p")
        text, listed = F.col("_best.rule"), F.col("_best.verdict")
    verdict = F.coalesce(listed, F.when(blocked_by_model(F.col("host"), F.col("path")), "block").otherwise("allow"))
    return out.withColumns({"rule": text, "verdict": verdict}).drop("_best")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every row of ``pages``. Null or no ``://``: empty host and path. Repeated rows each give their row; an
    empty table gives an empty result; extra columns are not read."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op8_sql() -> str:
    weights, offset = fitted()
    sums = " + ".join(f"coalesce(list_sum(list_transform(range(1, len(s) - {n} + 2), lambda i: w[({' + '.join(f's[i + {j}] * {31**j}' for j in range(n))} + {7 * n}) % {BUCKETS} + 1])), 0)" for n in SIZES)
    count = " + ".join(f"greatest(len(s) - {n} + 1, 0)" for n in SIZES)
    fits = "".join(f" WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN {{}}{i}" for i, r in sorted(enumerate(RULES), key=lambda x: -len(x[1].text)))
    texts, verdicts = ([f"'{getattr(r, k)}'" for r in RULES] for k in ("text", "verdict"))
    pick = lambda of: "CASE" + re.sub(r"\{\}(\d)", lambda m: of[int(m[1])], fits) + " END"
    lower = "translate(regexp_extract({}, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH m AS (SELECT {list(weights)} AS w),
u AS (SELECT page_id, {lower.format("coalesce(url, '')")} AS host, regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
c AS (SELECT u.*, w, list_transform(string_split('^' || host || '$' || path || '$', ''), lambda x: CAST(unicode(x) AS BIGINT)) AS s FROM u, m)
SELECT page_id, host, path, {pick(texts)} AS rule,
    coalesce({pick(verdicts)}, CASE WHEN {sums} + {offset} * sqrt({count}) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM c
"""
