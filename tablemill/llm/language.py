"""Languages of documents: what the text, the markup, the address and the host say, in one posterior.

    P(language | all) ~ P(text | language) P(declared | language) P(suffix | language) P(language | host)

- The text: naive Bayes over hashed character trigrams, fitted on a bounded sample of labelled rows. A long
  text would drown the other evidence, so its weight is that of at most ``text_weight`` trigrams.
- The declared language and the address suffix: tables of how often each goes with each language as the
  text alone tells it, over all rows, smoothed.
- The host: the languages of its rows, smoothed towards those of its domain, and these towards those of
  all rows. All are grouped aggregates; a host with a third of the rows is summed up before the shuffle.

A row is rejected if it has no letters or if the language it is in is not among those wanted. A text that every
language explains worse than trigrams drawn at random would is in none of them: it may well be a clean text in a
language without labelled rows. Such rows are rejected too, unless ``unknown`` names a class for them.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.store import ROW, Workspace, lean, numbered

BITS = 16
SAMPLE_ROWS = 2_000  # labelled rows a language's model is fitted on at most
BLOCK = 128  # languages whose model a task holds at a time: 32 MB
SLICE = 1 << 14  # trigrams of a text looked up at a time
RANK_BITS = 12
UNSEEN = 0.05  # of a text's trigrams are drawn from all alike
TEXT_WEIGHT = 40.0
STRENGTH = 20.0  # rows that a prior from the level above counts for
CHUNK = 1 << 18


@functools.cache
def _letters() -> np.ndarray:
    """Which code points of the basic plane are letters."""
    return np.array([chr(i).isalpha() for i in range(1 << 16)])


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of the lower-cased words of a text, each between two spaces."""
    out = []
    for at in range(0, len(text), CHUNK):
        part = text[max(0, at - 2) : at + CHUNK].lower()
        code = np.frombuffer(f" {part} ".encode("utf-32-le", errors="replace"), dtype="<u4").astype(np.uint64)
        letter = np.where(code < 1 << 16, _letters()[np.minimum(code, (1 << 16) - 1)], True)
        code = np.where(letter, code, 32)
        code = code[letter | np.concatenate(([True], letter[:-1]))]
        if len(code) < 3:
            continue
        gram = (code[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (code[2:] * np.uint64(0x165667B19E3779F9))
        gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((gram >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out) if out else np.empty(0, dtype=np.int64)


def _counted(batches):
    for batch in batches:
        total: dict[str, np.ndarray] = {}
        for label, text in zip(batch["label"], batch["text"], strict=True):
            if text:
                total.setdefault(label, np.zeros(1 << BITS, dtype=np.int64))[:] += np.bincount(trigrams(text), minlength=1 << BITS)
        for label, counts in total.items():
            gram = np.flatnonzero(counts)
            yield pd.DataFrame({"label": label, "gram": gram, "n": counts[gram]})


def label_of(column: str) -> Column:
    """A label in one spelling: lower case, no blanks around it, parts joined by hyphens."""
    return F.nullif(F.translate(F.trim(F.lower(F.col(column).cast("string"))), "_", "-"), F.lit(""))


class Model:
    """Languages and the log probability of each trigram in each, in blocks of languages small enough to be sent to a task."""

    def __init__(self, names: list[str], counts: DataFrame | None, ranked: DataFrame | None = None):
        self.names, self.counts = names, counts
        self.ranked = ranked  # the rows that were sorted by hash

    def blocks(self):
        """Arrays of at most BLOCK languages by trigrams, in the order of the names."""
        for at in range(0, len(self.names), BLOCK):
            place = {name: i for i, name in enumerate(self.names[at : at + BLOCK])}
            found = self.counts.where(F.col("label").between(self.names[at], self.names[at + len(place) - 1])).toPandas()
            table = np.zeros((len(place), 1 << BITS), dtype=np.float32)
            table[found["label"].map(place), found["gram"]] = found["n"]
            share = table / table.sum(1, keepdims=True, dtype=np.float64).clip(1)
            # an unseen trigram is as likely in a language of many labelled rows as in one of few
            yield np.log((1 - UNSEEN) * share + UNSEEN / (1 << BITS)).astype(np.float32)


def fit(docs: DataFrame, label: str, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of the labelled rows of smallest hash, of every label there is."""
    work = Workspace(docs.sparkSession, "model")
    rank = F.xxhash64(ROW)  # of the row, so that copies of a text are as many rows
    named = numbered(docs, work).select(ROW, label_of(label).alias("label"), F.col("text").cast("string").alias("text")).where("label is not null")
    # how many rows of a language have which leading bits of the hash; only the rows of one such bucket are ranked
    ranks = named.select("label", rank.alias("rank"), F.shiftright(rank, 64 - RANK_BITS).alias("bucket"))
    sizes = ranks.groupBy("label", "bucket").agg(F.count("*").alias("n")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("sizes"))
    none = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("bucket"))
    more = lambda s, x: F.struct((s["upto"] + x["n"]).alias("upto"), s["upto"].alias("below"), x["bucket"].alias("bucket"))
    edge = work.write(sizes.select("label", F.aggregate("sizes", none, lambda s, x: F.when(s["upto"] >= sample_rows, s).otherwise(more(s, x))).alias("edge")).select("label", "edge.*"))
    ranked = ranks.join(edge, ["label", "bucket"])
    at_edge = ranked.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("rank")))
    # the hash up to which a language's rows are taken
    last = work.write(at_edge.where(F.col("below") + F.col("place") <= sample_rows).groupBy("label").agg(F.max("rank").alias("last")))
    names = sorted(r["label"] for r in last.select("label").collect())
    if not names:
        return Model([], None)
    chosen = named.join(last, "label").where(rank <= F.col("last")).select("label", "text")
    counts = chosen.mapInPandas(lean("language", _counted), "label string, gram int, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    return Model(names, work.write(counts), ranked)


def _likelihoods(model: np.ndarray):
    """Mean log probability of a text's trigrams in each language, and their number."""
    by_gram = np.ascontiguousarray(model.T)

    def run(batches):
        for batch in batches:
            out = []
            for row, text in zip(batch[ROW], batch["text"], strict=True):
                gram = trigrams(text) if text else np.empty(0, dtype=np.int64)
                mean = np.zeros(by_gram.shape[1])
                for at in range(0, len(gram), SLICE):
                    mean += by_gram[gram[at : at + SLICE]].sum(0, dtype=np.float64)
                out.append((row, len(gram), mean / max(1, len(gram))))
            yield pd.DataFrame(out, columns=[ROW, "grams", "fit"])

    return run


def _by_value(known: DataFrame, *keys: str) -> DataFrame:
    """For each value of the keys, ``n``: how many of its rows the text alone gives to each language, a map by number."""
    pairs = known.where(F.col(keys[0]).isNotNull()).groupBy(*keys, "alone").agg(F.count("*").alias("n"))
    return pairs.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("alone").isNotNull(), F.struct("alone", "n")))).alias("n"))


def _totals(known: DataFrame, size: int) -> list[int]:
    found = {r["alone"]: r["count"] for r in known.where("alone is not null").groupBy("alone").count().collect()}
    return [found.get(i, 0) for i in range(size)]


def _of(n: Column, i: Column) -> Column:
    return F.coalesce(F.element_at(n, i), F.lit(0)).cast("double")


def _tables(known: DataFrame, column: str, size: int, work: Workspace) -> DataFrame:
    """log P(value | language) of every value, as an array named as the column with _says, from counts over all rows."""
    values = work.write(_by_value(known, column))
    total = F.array(*map(F.lit, _totals(known.where(F.col(column).isNotNull()), size)))
    below = F.lit(0.5 * (values.count() + 1))
    says = F.transform(total, lambda t, i: F.log((_of(F.col("n"), i) + 0.5) / (t + below)))
    return work.write(values.select(column, says.alias(f"{column}_says")))


def host_of(address: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host)


def markup_language(source: Column) -> Column:
    """The language that the html element declares, without its region, wherever in the tag it stands; null where none is."""
    return F.nullif(F.lower(F.regexp_extract(source, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))


def _host_priors(known: DataFrame, size: int, strength: float) -> tuple[DataFrame, list[float]]:
    """log P(language | host), smoothed by the host's domain, and that by all rows."""
    every = _totals(known, size)
    base = [(x + 1) / (sum(every) + size) for x in every]
    above = F.array(*map(F.lit, base))

    def smoothed(n: Column, up: Column) -> Column:
        rows = F.aggregate(F.map_values(n), F.lit(0).cast("long"), lambda a, b: a + b)
        return F.transform(up, lambda x, i: (_of(n, i) + strength * x) / (rows + strength))

    domains = _by_value(known, "domain").select("domain", smoothed(F.col("n"), above).alias("up"))
    hosts = _by_value(known, "host", "domain").join(domains, "domain")
    return hosts.select("host", F.transform(smoothed(F.col("n"), F.col("up")), lambda x: F.log(x)).alias("prior")), base


def identify(
    docs: DataFrame,
    label: str = "lang",
    declared: str | None = "lang",
    host: str | None = "source",
    address: str | None = None,
    wanted: list[str] | None = None,
    sample_rows: int = SAMPLE_ROWS,
    text_weight: float = TEXT_WEIGHT,
    strength: float = STRENGTH,
    model: Model | None = None,
    unknown: str | None = None,
) -> DataFrame:
    """Adds language, confidence (its posterior), text_language (by the text alone) and accepted.

    ``label`` names the column whose values the text model is fitted on, unless ``model`` is one that was
    fitted on other rows; any number of languages is fitted. ``declared`` is what the markup declares, ``address`` a URL from which host, domain and suffix are taken, ``host`` a host's name where
    there is no URL. Evidence that is null says nothing. ``wanted`` are the languages to accept, all if
    None. ``unknown`` is the language given to texts with letters that no fitted language explains; they are
    then accepted as those of any other language are, and have no confidence.

    A row without letters (a null, empty or blank text, numbers) has no text_language and is rejected; its
    language is what the other evidence says. Without any labelled row every language is null and nothing
    is accepted, or every text with letters is ``unknown``. Rows that repeat are each judged alike; an empty table gives an empty one. Columns of the
    names added are replaced; names that begin with ``_op_`` are the operator's own.
    """
    spark = docs.sparkSession
    made = ["language", "confidence", "text_language", "accepted"]
    same = [c for c in docs.columns if c not in made]
    model = fit(docs, label, sample_rows) if model is None else model
    names = model.names
    if not names:
        none = F.lit(None)
        name = F.when(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(unknown).cast("string"))
        taken = name.isNotNull() & (name.isin(wanted) if wanted is not None else F.lit(True))
        return docs.select(*same, name.alias("language"), none.cast("double").alias("confidence"), name.alias("text_language"), F.coalesce(taken, F.lit(False)).alias("accepted"))
    work = Workspace(spark, "language")
    null = F.lit(None).cast("string")
    where = host_of(F.col(address)) if address else F.lower(F.col(host).cast("string")) if host else null
    said = label_of(declared) if declared else null
    numbers = numbered(docs, work)
    facts = numbers.select(ROW, said.alias("declared"), where.alias("host")).select(ROW, "declared", "host", domain_of(F.col("host")).alias("domain"), (suffix_of(F.col("host")) if address else null).alias("suffix"))
    rows = numbers.select(ROW, F.col("text").cast("string").alias("text"))
    texts = None
    for block in model.blocks():
        part = rows.mapInPandas(lean("language", _likelihoods(block)), f"{ROW} long, grams long, fit array<double>")
        texts = part if texts is None else texts.join(part.select(ROW, F.col("fit").alias("more")), ROW).select(ROW, "grams", F.concat("fit", "more").alias("fit"))
    alone = F.when(F.col("grams") > 0, F.array_position("fit", F.array_max("fit")).cast("int") - 1)
    known = work.write(facts.join(texts, ROW).withColumn("alone", alone))

    priors, base = _host_priors(known, len(names), strength)
    joined = known.join(priors, "host", "left")
    evidence = []
    for column in [c for c, given in (("declared", declared), ("suffix", address)) if given]:
        joined = joined.join(_tables(known, column, len(names), work), column, "left")
        evidence.append(F.coalesce(f"{column}_says", F.array_repeat(F.lit(0.0), len(names))))
    weight = F.least(F.col("grams").cast("double"), F.lit(text_weight))
    score = F.transform("fit", lambda x: x * weight)
    for more in [*evidence, F.coalesce("prior", F.array(*[F.lit(float(np.log(b))) for b in base]))]:
        score = F.zip_with(score, more, lambda a, b: a + b)
    scored = joined.withColumn("score", score).withColumn("top", F.array_max("score"))
    spread = F.aggregate(F.transform("score", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, b: a + b)
    listed = F.array(*map(F.lit, names))
    language = F.element_at(listed, F.array_position("score", F.col("top")).cast("int"))
    chance = -BITS * float(np.log(2))
    fits = (F.col("grams") > 0) & (F.array_max("fit") > chance)
    by_text = F.when(F.col("grams") > 0, F.element_at(listed, F.col("alone") + 1))
    confidence = 1 / spread
    if unknown is not None:
        stray = (F.col("grams") > 0) & ~fits
        language, by_text = (F.when(stray, F.lit(unknown)).otherwise(c) for c in (language, by_text))
        confidence, fits = F.when(~stray, confidence), F.col("grams") > 0
    told = scored.select(ROW, language.alias("_op_language"), confidence.alias("_op_confidence"), by_text.alias("_op_alone"), F.coalesce(fits, F.lit(False)).alias("_op_fits"))
    told = work.write(told)
    accepted = F.col("_op_fits") & (F.col("_op_language").isin(wanted) if wanted is not None else F.lit(True))
    columns = [F.col("_op_language").alias("language"), F.col("_op_confidence").alias("confidence"), F.col("_op_alone").alias("text_language"), accepted.alias("accepted")]
    return numbers.select(ROW, *same).join(told, ROW).select(*same, *columns)


def accepted(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that ``identify`` accepts."""
    return identify(docs, **settings).where("accepted").select(*docs.columns)
