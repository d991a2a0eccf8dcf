"""Personal data in texts: fixed forms as seeds, and what their contexts give away.

The seeds are addresses, IP addresses, card and phone numbers found by their form. The words before a seed
are a lexical pattern. Patterns and identifier-like tokens form a graph, which is scored in turns: a
pattern is as good as the share of its instances that are known identifiers of a kind, an instance as the
patterns that surround it. Tokens beside a pattern of high enough score are identifiers as well, though their
form alone would not have told; from the next turn on they count as known and can make further patterns.

DataFrame and SQL functions only. Matching and splitting a text by the same expression gives both the
matches and the lengths between them, so positions are running sums over the few matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemill.llm.store import ROW, Workspace, numbered

KINDS = ("email", "ip", "card", "phone")
#: The fixed forms. A run that cannot begin a match is entered at its head only, and runs that need not
#: give anything back are possessive; both leave the matches as they are and the time linear.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a form to be looked for.
SIGNS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Tokens that may be identifiers: those with a digit or an @.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
LAST_WORDS = r"^\s*+(\S++\s++\S++)"  # of a text read backwards

ROUNDS = 3
SUPPORT = 3
CONFIDENCE = 0.8


def _luhn(token: Column) -> Column:
    """Whether the digits of a token pass the check sum."""
    digits = F.reverse(F.regexp_replace(token, "[^0-9]", ""))
    place = F.sequence(F.lit(1), F.length(digits))

    def worth(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(place, worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: Column, token: Column) -> Column:
    digits = F.length(F.regexp_replace(token, "[^0-9]", ""))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", token.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
        .when(kind == "card", F.when(digits.between(14, 19), _luhn(token)).otherwise(F.lit(False)))
        .when(kind == "phone", digits.between(10, 15))
        .otherwise(F.lit(False))
    )


def _matches(rows: DataFrame) -> DataFrame:
    """Every match of a form or of TOKEN: row, kind, start, end, token and the two words before it, however long."""
    text = F.col("text")
    shape = "array<struct<kind:string,gap:int,before:string,token:string>>"
    found = []

    def hit(kind):
        return lambda gap, token: F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"), F.reverse(F.regexp_extract(F.reverse(gap), LAST_WORDS, 1)).alias("before"), token.alias("token"))

    for kind, form in {**FORMS, "token": TOKEN}.items():
        pairs = F.zip_with(F.split(text, form, -1), F.regexp_extract_all(text, F.lit(form), F.lit(0)), hit(kind)).cast(shape)
        sign = text.contains(SIGNS[kind]) if SIGNS.get(kind) else F.lit(True)
        found.append(F.when(sign & text.rlike("[0-9@]"), pairs).otherwise(F.array().cast(shape)))
    exploded = rows.where(text.rlike("[0-9@]")).select(ROW, F.explode(F.array(*found)).alias("of")).select(ROW, F.posexplode("of").alias("i", "hit"))
    exploded = exploded.where("hit.token is not null").select(ROW, "i", "hit.*")
    upto = Window.partitionBy(ROW, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.length("token")).over(upto)
    return exploded.withColumn("end", end).withColumn("start", F.col("end") - F.length("token"))


def _trimmed(tokens: DataFrame) -> DataFrame:
    """Tokens without the punctuation around them."""
    head = F.length(F.regexp_extract("token", r"^([^A-Za-z0-9+]*+)", 1))
    tail = F.length(F.regexp_extract(F.reverse("token"), r"^([^A-Za-z0-9]*+)", 1))
    cut = tokens.withColumn("head", head).withColumn("tail", tail)
    cut = cut.withColumn("token", F.substring(F.col("token"), F.col("head") + 1, F.length("token") - F.col("head") - F.col("tail")))
    return cut.withColumn("start", F.col("start") + F.col("head")).withColumn("end", F.col("end") - F.col("tail")).where("end > start")


def _clear_of(tokens: DataFrame, base: DataFrame) -> DataFrame:
    """The tokens that touch no base span."""
    cols = [ROW, "start", "end", "token", "before"]
    both = tokens.select(*cols, F.lit(False).alias("base")).unionByName(base.select(*cols, F.lit(True).alias("base")))
    here = Window.partitionBy(ROW).orderBy("start")
    past = F.max(F.when(F.col("base"), F.col("end"))).over(here.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(here.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    free = (F.coalesce("past", F.lit(0)) <= F.col("start")) & (F.coalesce("ahead", F.col("end")) >= F.col("end"))
    return both.withColumn("past", past).withColumn("ahead", ahead).where(~F.col("base") & free)


def _pattern(before: Column) -> Column:
    """The two words before a match, or null where there are not two."""
    return F.nullif(F.regexp_replace(F.lower(before), r"\s+", " "), F.lit(""))


def discovered(base: DataFrame, tokens: DataFrame, work: Workspace, rounds: int, support: int, confidence: float) -> DataFrame:
    """Tokens outside the base spans that the pattern graph takes for identifiers, with their kind."""
    free = _clear_of(_trimmed(tokens), base).withColumn("pattern", _pattern(F.col("before"))).where("pattern is not null")
    # an identifier no form covers still has an @ inside or six digits
    free = free.where(F.col("token").rlike(r"[^@]@[^@]") | (F.length(F.regexp_replace("token", "[^0-9]", "")) >= 6))
    free = work.write(free.withColumn("value", F.lower("token")))
    seeds = base.select("kind", _pattern(F.col("before")).alias("pattern"), F.lower("token").alias("value")).where("pattern is not null").distinct()
    seeds = work.write(seeds)
    edges = work.write(free.select("pattern", "value").distinct())
    total = work.write(seeds.select("pattern", "value").unionByName(edges).distinct().groupBy("pattern").agg(F.count("*").alias("all")))
    known, values, score = seeds, None, None
    for _ in range(rounds):
        # known values count whole, other kinds' not at all, all others by what they were worth in the last turn
        planted = known.groupBy("pattern", "kind").agg(F.count("*").alias("known")).where(F.col("known") >= support).join(total, "pattern")
        share = F.col("known")
        if values is not None:
            open_ = edges.join(values.where(F.col("best") < confidence), "value").join(known.select("pattern", "value").distinct(), ["pattern", "value"], "left_anti")
            planted = planted.join(open_.groupBy("pattern", "kind").agg(F.sum("worth").alias("gained")), ["pattern", "kind"], "left")
            share = share + F.coalesce("gained", F.lit(0.0))
        score = work.write(planted.select("pattern", "kind", F.least(share / F.col("all"), F.lit(1.0)).alias("score")))
        # an instance is missed only if all its patterns are wrong
        miss = F.exp(F.sum(F.log(1 - F.least("score", F.lit(1 - 1e-9)))))
        values = work.write(edges.join(score, "pattern").groupBy("value", "kind").agg((1 - miss).alias("worth"), F.max("score").alias("best")))
        # what a good pattern leads to is known from now on, wherever it stands
        more = edges.join(values.where(F.col("best") >= confidence), "value").select("kind", "pattern", "value")
        known = work.write(seeds.unionByName(more).distinct())
    if score is None:
        return free.select(ROW, F.lit(None).cast("string").alias("kind"), "start", "end").where("false")
    good = score.where(F.col("score") >= confidence).select("pattern", "kind")
    values = values.where(F.col("best") >= confidence).select("value", "kind", F.col("best").alias("worth"))
    taken = free.join(good, "pattern").join(values, ["value", "kind"])
    best = F.row_number().over(Window.partitionBy(ROW, "start").orderBy(F.desc("worth"), "kind"))
    return taken.withColumn("best", best).where("best = 1").select(ROW, "kind", "start", "end")


def spans(rows: DataFrame, work: Workspace, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """All spans: row, kind, start, end (code points, end exclusive) and whether the form alone told."""
    found = work.write(_matches(rows))
    base = work.write(found.where(F.col("kind") != "token").where(_valid(F.col("kind"), F.col("token"))))
    more = discovered(base, found.where("kind = 'token'"), work, rounds, support, confidence)
    return work.write(base.select(ROW, "kind", "start", "end", F.lit(True).alias("base")).unionByName(more.select(ROW, "kind", "start", "end", F.lit(False).alias("base"))))


def _joined(only_base: bool) -> Column:
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    item = F.struct("start", order.alias("of"), "end", F.concat_ws(":", "kind", "start", "end").alias("said"))
    listed = F.sort_array(F.collect_list(F.when(F.col("base"), item) if only_base else item))
    return F.array_join(F.transform(listed, lambda s: s["said"]), ",")


def find(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone and base (spans told by form), and spans (all of them).

    Spans are written kind:start:end, by start and then kind, joined by commas. A null or empty text has
    none. Spans of different kinds may overlap; discovered ones touch no base span. A pattern is the two
    words before a value, however long they are; a value that no form covers must have an @ inside or six
    digits to be looked at, since shorter numbers are years, counts and prices. Rows that repeat are each
    looked at; an empty table gives an empty one. Columns of the names added are replaced, and names
    that begin with ``_op_`` are the operator's own.
    """
    work = Workspace(docs.sparkSession, "personal")
    rows = numbered(docs, work)
    found = spans(rows.select(ROW, F.col("text").cast("string").alias("text")), work, rounds, support, confidence)
    counts = [F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"_op_n_{k}") for k in KINDS]
    told = work.write(found.groupBy(ROW).agg(*counts, _joined(True).alias("_op_base"), _joined(False).alias("_op_spans")))
    made = [*(f"n_{k}" for k in KINDS), "base", "spans"]
    same = [c for c in docs.columns if c not in made]
    filled = [F.coalesce(f"_op_{c}", F.lit(0).cast("long") if c.startswith("n_") else F.lit("")).alias(c) for c in made]
    return rows.select(ROW, *same).join(told, ROW, "left").select(*same, *filled)


def redact(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; spans that overlap become one.

    Texts without spans, null ones among them, stay as they are.
    """
    work = Workspace(docs.sparkSession, "redacted")
    rows = numbered(docs, work)
    found = spans(rows.select(ROW, F.col("text").cast("string").alias("text")), work, rounds, support, confidence)
    here = Window.partitionBy(ROW).orderBy("start", "end", "kind")
    reach = F.max("end").over(here.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.withColumn("reach", reach).withColumn("run", F.sum((F.coalesce("reach", F.lit(-1)) < F.col("start")).cast("int")).over(here))
    merged = runs.groupBy(ROW, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))
    after = F.coalesce(F.lag("end").over(Window.partitionBy(ROW).orderBy("start")), F.lit(0))
    merged = merged.withColumn("from", after)
    lists = work.write(merged.groupBy(ROW).agg(F.sort_array(F.collect_list(F.struct("start", "end", "from", "kind"))).alias("_op_cuts")))
    text = F.col("text").cast("string")

    def part(s):
        kept = F.substring(text, s["from"].cast("int") + 1, (s["start"] - s["from"]).cast("int"))
        return F.concat(kept, F.lit("["), s["kind"], F.lit("]"))

    rest = F.substring(text, F.element_at("_op_cuts", -1)["end"].cast("int") + 1, F.length(text))
    clean = F.when(F.col("_op_cuts").isNull(), text).otherwise(F.concat(F.array_join(F.transform("_op_cuts", part), ""), rest))
    return rows.join(lists, ROW, "left").select(*[clean.alias("text") if c == "text" else F.col(c) for c in docs.columns])

