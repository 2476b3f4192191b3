"""URL verdicts: rules first, then a logistic regression on hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm.common import grouped, prepare

DIMENSIONS = 1 << 18
LENGTHS = (3, 4, 5)
#: Labelled rows that the classifier is fitted on at most (a hash order of the urls picks them).
MAX_LABELLED = 20_000
#: Folds of hosts, and the share of ordinary urls on hosts out of the fit that may be blocked.
FOLDS, FALSE_BLOCKS = 4, 0.02

#: The rules of the contract, as (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Words of the small labelled url table, written by hand and from no table of this
#: repository.  Unwanted: kinds of site that public blocklists commonly hold (gambling,
#: sham pharmacies, adult, pirated software, advert servers, quick loans, fakes).
UNWANTED = ("casino poker roulette blackjack betting sportsbet slots jackpot bingo lottery viagra cialis steroid pills "
            "painkiller slimming porn xxx nude escort webcam adult hookup warez keygen torrent cracked serialz "
            "adserver popunder banner clickbait tracker spam payday quickloan cashadvance replica fakewatch "
            "freegift winner prize cheap").split()
#: Ordinary: words that names of public sites are commonly made of.
WANTED = ("news times herald gazette library school university college museum science physics biology health hospital "
          "garden travel railway airport recipe kitchen history music theatre weather city council parliament forum wiki "
          "docs developer software research journal review sport football cycling energy climate market bank insurance "
          "family water paper house furniture church charity community foundation institute standards photo film radio "
          "books poetry language street north river mountain island harbour").split()
#: Hosts of well-known public sites, from memory: names of no common word, all ordinary.
KNOWN = ("www.google.com mail.yahoo.com www.bing.com duckduckgo.com www.apple.com www.microsoft.com www.mozilla.org "
         "www.debian.org www.kernel.org www.gnu.org www.python.org www.oracle.com www.ibm.com www.intel.com www.nvidia.com "
         "www.samsung.com www.sony.com www.nokia.com www.siemens.com www.bosch.de www.bmw.de www.renault.fr www.toyota.com "
         "www.reuters.com apnews.com www.theguardian.com www.nytimes.com www.washingtonpost.com www.economist.com "
         "www.ft.com www.bloomberg.com www.cnn.com www.npr.org www.aljazeera.com www.zeit.de www.faz.net www.tagesschau.de "
         "www.sueddeutsche.de www.liberation.fr www.lefigaro.fr www.elmundo.es www.lavanguardia.com www.corriere.it "
         "www.repubblica.it www.nzz.ch www.derstandard.at www.un.org www.unesco.org www.unicef.org www.oecd.org "
         "www.imf.org www.worldbank.org www.wto.org www.redcross.org www.amnesty.org www.cern.ch www.esa.int www.noaa.gov "
         "www.usgs.gov www.nih.gov www.cdc.gov www.loc.gov www.gov.uk www.service-public.fr www.bund.de www.mit.edu "
         "www.stanford.edu www.harvard.edu www.cam.ac.uk www.ethz.ch www.tum.de www.sorbonne-universite.fr www.uam.es "
         "www.acm.org www.ieee.org www.iso.org www.w3.org www.ietf.org www.jstor.org www.springer.com www.elsevier.com "
         "www.britannica.com www.merriam-webster.com dict.leo.org www.linguee.com www.deepl.com www.openstreetmap.org "
         "www.amazon.com www.ebay.de www.ikea.com www.otto.de www.zalando.de www.fnac.com www.decathlon.fr www.lidl.de "
         "www.etsy.com www.booking.com www.tripadvisor.com www.airbnb.com www.lufthansa.com www.renfe.com www.sncf.com "
         "www.youtube.com vimeo.com www.spotify.com soundcloud.com bandcamp.com www.flickr.com www.reddit.com "
         "www.linkedin.com www.facebook.com medium.com substack.com www.quora.com www.twitch.tv www.netflix.com "
         "www.goodreads.com www.fifa.com www.uefa.com www.olympics.com www.chess.com www.louvre.fr www.tate.org.uk "
         "www.prado.es www.vangoghmuseum.nl www.smithsonianmag.com www.nationalgeographic.com www.gitlab.com "
         "bitbucket.org sourceforge.net www.npmjs.com pypi.org crates.io hub.docker.com www.postgresql.org").split()
#: Common forms of hosts (NAME is a word or two) and of paths (WORD is an
#: ordinary word, # a number), the same for both labels.
HOSTS = ("www.NAME.com", "NAME.org", "NAME.net", "www.NAME.co.uk", "NAME.de", "www.NAME.fr", "NAME.io", "shop.NAME.com",
         "NAME.wordpress.com", "www.NAME.es", "m.NAME.net", "blog.NAME.org")
PATHS = ("/", "/index.html", "/about", "/WORD/#", "/2021/03/WORD-WORD", "/category/WORD", "/WORD.php", "/en/WORD",
         "/contact", "/wiki/WORD", "/p/#/WORD")


def seed_urls() -> list[tuple[str, int]]:
    """The small labelled table (url, 1 unwanted): each word, alone and with
    others, under common host and path forms, and known hosts with such paths."""
    out, plain = [], 0

    def path(i):
        nonlocal plain
        p = PATHS[i % len(PATHS)].replace("#", str(37 * i % 9973))
        while "WORD" in p:
            p = p.replace("WORD", WANTED[plain % len(WANTED)], 1)
            plain += 1
        return p

    for words, label, rounds in ((UNWANTED, 1, 3), (WANTED, 0, 1)):
        for i, w in enumerate(words * rounds):
            near, far = words[(i * 3 + i // len(words) + 1) % len(words)], words[(i * 7 + i // len(words) + 5) % len(words)]
            other = WANTED[(i * 5 + 3) % len(WANTED)]
            for j, name in enumerate((w, w + near, f"{w}-{far}", f"{far}{w}", f"the{w}", f"{w}online", f"{other}-{w}")):
                host = HOSTS[(i * 5 + j) % len(HOSTS)].replace("NAME", name)
                out.append((f"{('http', 'https')[(i + j) % 2]}://{host}{path(i * 3 + j * 4)}", label))
    out += [(f"https://{host}{path(i * 5 + 3 * j)}", 0) for i, host in enumerate(KNOWN) for j in range(4)]
    return out


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: from there up to ``?``, ``#`` or the end; both empty for
    a null url or one without ``://``."""
    form = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, form, i), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits (its host or a subdomain, path by prefix), as
    struct(size, rule, verdict); null if none does."""
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p),
                   F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for v, h, p in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every character n-gram of the texts, repeats included."""
    rows, slots = [], []
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    owner = np.repeat(np.arange(len(texts)), np.diff(stops, prepend=0))
    for n in LENGTHS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ data[i:len(data) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = owner[:len(h)] == owner[n - 1:]
        rows.append(owner[:len(h)][inside])
        slots.append((h[inside] % np.uint64(DIMENSIONS)).astype(np.int64))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *slots])


def _texts(host: list[str], path: list[str]) -> list[bytes]:
    """Host between marks, then the path with digits folded."""
    fold = str.maketrans("123456789", "000000000")
    return [f"^{h}$ {p.translate(fold)}".encode() for h, p in zip(host, path)]


def _logit(row: np.ndarray, slot: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    size = np.maximum(np.bincount(row, minlength=n), 1)
    return np.bincount(row, weights[slot], minlength=n) / np.sqrt(size) + weights[-1]


def fit(urls: pd.DataFrame, rounds: int = 300, rate: float = 2.0, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) by full-batch gradient steps on rows
    (host, path, label); repeated rows weigh as often as they occur."""
    n, y = len(urls), urls["label"].to_numpy(float)
    row, slot = features(_texts(urls["host"].tolist(), urls["path"].tolist()))
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
    used, at = np.unique(slot, return_inverse=True)
    w = np.zeros(len(used) + 1)
    for _ in range(rounds if n else 0):
        gap = (1 / (1 + np.exp(-_logit(row, at, n, w))) - y) / n
        step = np.bincount(at, (gap * scale)[row], minlength=len(w))
        step[-1] = gap.sum()
        w -= rate * (step * 8 + decay * w)
    whole = np.zeros(DIMENSIONS + 1)
    whole[used], whole[-1] = w[:-1], w[-1]
    return whole


def threshold_of(urls: pd.DataFrame, false_blocks: float = FALSE_BLOCKS) -> float:
    """The probability that at most ``false_blocks`` of the ordinary rows
    exceed when their host is in no row of the fit: hosts are dealt into FOLDS,
    each scored by a fit on the others.  0.5 at least."""
    fold = pd.util.hash_array(urls["host"].to_numpy(object), categorize=False) % FOLDS
    p = []
    for i in range(FOLDS):
        out = urls[(fold == i) & (urls["label"] == 0)]
        w = fit(urls[fold != i])
        row, slot = features(_texts(out["host"].tolist(), out["path"].tolist()))
        p.append(1 / (1 + np.exp(-_logit(row, slot, len(out), w))))
    p = np.concatenate(p)
    return max(0.5, float(np.quantile(p, 1 - false_blocks, method="higher"))) if len(p) else 0.5


def train(labelled: DataFrame, max_rows: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """Weights and threshold of ``labelled`` (url, label), of ``max_rows`` rows
    at most, taken in a fixed hash order.  Rows without a label are left out."""
    host, path = host_path(F.col("url"))
    rows = (labelled.where("label is not null").orderBy(F.xxhash64("url"), "url", "label").limit(max_rows)
            .select(host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label")))
    urls = rows.toPandas()
    return fit(urls), threshold_of(urls)


def url_verdicts(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] = RULES,
                 threshold: float | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block) for every row of ``pages``.

    The longest rule that fits decides; else the classifier does, by a
    ``threshold`` that is set on held-out hosts (``threshold_of``) if none is
    given, on any text:
    a null url has empty host and path and takes the verdict of the empty url.
    Repeated rows each give a row; an empty table gives none; other columns are
    ignored.  With no labelled rows the classifier allows everything."""
    spark = prepare(pages.sparkSession)
    fitted, calibrated = train(labelled)
    threshold = calibrated if threshold is None else threshold
    weights = spark.sparkContext.broadcast(fitted.astype(np.float32))  # DIMENSIONS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for b in batches:
            texts, p = _texts(b.column("host").to_pylist(), b.column("path").to_pylist()), []
            for i, j in grouped([len(t) for t in texts], 1 << 20):
                row, slot = features(texts[i:j])
                p.append(1 / (1 + np.exp(-_logit(row, slot, j - i, w))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([*p, np.empty(0)]))],
                                             [*b.schema.names, "p_block"])

    host, path = host_path(F.col("url").cast("string"))
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    scored = read.mapInArrow(run, "page_id long, host string, path string, p_block double")
    model = F.when(F.col("p_block") > threshold, "block").otherwise("allow")
    return (scored.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
            .select("page_id", "host", "path", F.col("fit.rule").alias("rule"),
                    F.coalesce("fit.verdict", model).alias("verdict"), "p_block"))


def seed_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(seed_urls(), "url string, label int")
