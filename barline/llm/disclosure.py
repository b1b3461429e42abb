"""Personal data: patterns, and information-theoretic sanitisation of the terms around them.

Four patterns find the protected entities. A term is a run of at least four letters, in small letters. Its
*disclosure* of an entity is their pointwise mutual information as a share of the entity's information content, both
estimated from all documents: with N documents, n(c) that hold the entity, n(t) that hold the term and n(c, t) that
hold the term in the entity's context,

    disclosure = ln(N n(c,t) / (n(c) n(t))) / ln(N / n(c)).

The context are the ``CONTEXT`` nearest terms on either side, up to the neighbouring matches of the same pattern. 1
means that the term says as much as the entity itself. A term that at least ``SUPPORT`` documents show and that
discloses more than ``DISCLOSED`` of an entity is found in every document that holds the entity. It is generalised
to its first ``STEM`` letters if these, counted in the same way, disclose no more than that; otherwise it is removed.
Documents without an entity are left alone.

Rules: null text is empty. Patterns match leftmost, without overlaps within a kind; a match that fails its test is
dropped and not tried again. Positions are code points, ends exclusive. Entities are compared by digits (card,
phone), in small letters (email) or as they are (ip). Terms inside the four kinds' spans are not listed again. Equal
texts have equal spans. Rows count on their own, whatever their ids; other columns are kept by ``sanitise``. An
empty table gives no rows; an entity in every document has no information to disclose.

All steps are built-in functions. Counts are combined before the shuffle. Arrays are as long as a text at most:
positions come from sums over blocks of pieces, so a text of n matches costs some n * ``_BLOCK`` steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.session import settle

CONTEXT, SUPPORT, DISCLOSED, STEM = 8, 2, 0.75, 3
KINDS = ("email", "ip", "card", "phone", "term")
TERM = r"\p{L}{4,}"
# Fixed patterns. Those below match the same texts without going back over what they have read.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
_LOCAL = "[A-Za-z0-9._%+-]"
_QUICK = {"email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
          "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
          "card": r"[0-9](?:[\x20-]?[0-9])++", "phone": PATTERNS["phone"]}
_MAY_HOLD = r"@|\+[0-9]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9](?:[\x20-]?[0-9]){11}"
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
_BLOCK = 64


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once although ``use`` names it several times."""
    return F.get(F.transform(F.array(value), use), 0)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def _matches(text: Column, pattern: str) -> Column:
    """Every match with its ``start`` and ``end`` in code points, the match, and the pieces of text next to it."""

    def steps(split: Column) -> Column:
        pieces, found = split["pieces"], split["found"]
        length = F.transform(pieces, lambda p, k: (F.length(p) + F.coalesce(F.length(F.get(found, k)), F.lit(0))).cast("long"))
        return F.struct(pieces.alias("pieces"), found.alias("found"), length.alias("steps"))

    def sums(split: Column) -> Column:
        last = F.floor((F.size(split["steps"]) - 1) / _BLOCK).cast("int")
        totals = F.transform(F.sequence(F.lit(0), last), lambda b: _total(F.slice(split["steps"], b * _BLOCK + 1, _BLOCK)))
        return F.struct(split["pieces"].alias("pieces"), split["found"].alias("found"), split["steps"].alias("steps"), totals.alias("totals"))

    def place(split: Column) -> Column:
        def one(match: Column, k: Column) -> Column:
            block = F.floor(k / _BLOCK).cast("int")
            before = (_total(F.slice(split["totals"], 1, block)) + _total(F.slice(split["steps"], block * _BLOCK + 1, k % _BLOCK))
                      + F.length(F.get(split["pieces"], k)))
            return F.struct(before.alias("start"), (before + F.length(match)).alias("end"), match.alias("match"),
                            F.get(split["pieces"], k).alias("left"), F.get(split["pieces"], k + 1).alias("right"))

        return F.transform(split["found"], one)

    split = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return _let(_let(_let(split, steps), sums), place)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _nearest(left: Column, right: Column) -> Column:
    before = _let(_terms(left), lambda w: F.slice(w, F.greatest(F.size(w) - CONTEXT + 1, F.lit(1)), CONTEXT))
    return F.concat(before, F.slice(_terms(right), 1, CONTEXT))


def _stem(term: Column) -> Column:
    return F.concat(F.substring(term, 1, STEM), F.lit("*"))


_TESTS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda m: F.length(_digits(m)).between(12, 19) & F.call_function("luhn_check", _digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}
_NAMES = {"email": F.lower, "ip": lambda m: m, "card": _digits, "phone": _digits}
_HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}

_SPAN = "struct<start:bigint,kind:int,end:bigint,entity:string,context:array<string>>"


def _entities(text: Column) -> Column:
    """The spans of the four kinds in order, each with its entity and the terms of its context."""

    def of(kind: str) -> Column:
        good = F.filter(_matches(text, _QUICK[kind]), lambda m: _TESTS[kind](m["match"]))
        made = F.transform(good, lambda m: F.struct(
            m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"),
            F.concat(F.lit(f"{kind}:"), _NAMES[kind](m["match"])).alias("entity"), _nearest(m["left"], m["right"]).alias("context")))
        return F.when(text.rlike(_HINTS[kind]), made).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return F.sort_array(F.concat(*(of(kind) for kind in KINDS[:-1])))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def disclosing(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``entity``, ``term``, ``disclosure``, ``general`` (whether its stem may stay) of the terms that disclose too much.

    ``texts`` has a ``text`` a document, ``found`` its ``base`` spans.
    """
    n = found.count()
    spans = found.withColumn("row", F.monotonically_increasing_id()).select("row", F.explode("base").alias("s"))
    with_stems = lambda terms: F.array_distinct(F.concat(terms, F.transform(terms, _stem)))
    held = spans.select("row", "s.entity").distinct().groupBy("entity").agg(F.count("*").alias("n_c"))
    near = (spans.select("row", "s.entity", F.explode(with_stems(F.col("s.context"))).alias("term")).distinct()
            .groupBy("entity", "term").agg(F.count("*").alias("n_ct")).where(F.col("n_ct") >= SUPPORT))
    near = settle(near, "contexts")
    spread = texts.select(F.explode(with_stems(_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    spread = near.select("term").distinct().join(spread, "term")
    share = F.log(F.lit(float(n)) * F.col("n_ct") / (F.col("n_c") * F.col("n_t"))) / F.log(F.lit(float(n)) / F.col("n_c"))
    scored = settle(near.join(spread, "term").join(held, "entity").where(F.col("n_c") < n)
                    .select("entity", "term", share.alias("disclosure")), "disclosures")
    words = scored.where(~F.col("term").endswith("*") & (F.col("disclosure") > DISCLOSED)).withColumn("stem", _stem(F.col("term")))
    stems = scored.where(F.col("term").endswith("*")).select("entity", F.col("term").alias("stem"), F.col("disclosure").alias("rest"))
    return words.join(stems, ["entity", "stem"], "left").select(
        "entity", "term", "disclosure", (F.col("rest") <= DISCLOSED).alias("general"))


def _found(docs: DataFrame, *more: str) -> DataFrame:
    """Every row with its ``digest``, its ``base`` spans and its ``terms`` (``start``, ``end``, ``general``)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(text.alias("text"))
    # Texts stay where they are: what is found is told by digest.
    base = settle(docs.select(*more, _digest(text).alias("digest"), _entities(text).alias("base")), "entities")
    shown = disclosing(texts, base.select("base")).groupBy("entity").agg(F.collect_list(F.struct("term", "general")).alias("shown"))
    held = base.select("digest", F.explode("base.entity").alias("entity")).distinct()
    aims = settle(held.join(shown, "entity").groupBy("digest").agg(F.flatten(F.collect_list("shown")).alias("shown"))
                  .select("digest", F.array_distinct("shown.term").alias("all"),
                          F.array_distinct(F.transform(F.filter("shown", lambda s: ~s["general"]), lambda s: s["term"])).alias("removed")), "disclosing-terms")
    where = F.transform(F.filter(_matches(F.col("text"), TERM), lambda m: F.array_contains("all", F.lower(m["match"]))),
                        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"),
                                           (~F.array_contains("removed", F.lower(m["match"]))).alias("general")))
    named = texts.where(F.col("text").rlike(_MAY_HOLD)).withColumn("digest", _digest(F.col("text")))
    spans = settle(named.join(aims, "digest").select("digest", where.alias("terms")).groupBy("digest").agg(F.first("terms").alias("terms")), "terms")
    joined = base.join(spans, "digest", "left")
    covered = lambda t: F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    free = F.coalesce(F.filter("terms", lambda t: ~covered(t)), F.array().cast("array<struct<start:bigint,end:bigint,general:boolean>>"))
    return joined.withColumn("terms", free)


def _told(base: Column, terms: Column) -> Column:
    """All spans in order: ``start``, ``kind``, ``end``."""
    plain = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.sort_array(F.concat(plain, F.transform(terms, lambda t: F.struct(
        t["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), t["end"].alias("end")))))


def _joined(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with the text rewritten: entities become ``[KIND]``, terms their stem and ``*``, or ``[...]``.

    Overlapping spans are rewritten as one, by the first. A null text stays null; other columns are untouched.
    """
    mine = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(
        F.lit("["), F.get(F.array(*(F.lit(k.upper()) for k in KINDS)), s["kind"]), F.lit("]")).alias("by")))
    text = F.col("text").cast("string")
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(
        t["general"], F.concat(F.substring(text, (t["start"] + 1).cast("int"), F.lit(STEM)), F.lit("*"))).otherwise("[...]").alias("by")))

    def rewritten(spans: Column) -> Column:
        def part(s: Column, k: Column) -> Column:
            done = F.coalesce(F.array_max(F.transform(F.slice(spans, 1, k), lambda p: p["end"])), F.lit(0).cast("long"))
            kept = F.substring(text, (done + 1).cast("int"), F.greatest(s["start"] - done, F.lit(0)).cast("int"))
            return F.when(s["start"] < done, F.lit("")).otherwise(F.concat(kept, s["by"]))

        end = F.coalesce(F.array_max(F.transform(spans, lambda p: p["end"])), F.lit(0).cast("long"))
        return F.concat(F.array_join(F.transform(spans, part), ""), F.substring(text, (end + 1).cast("int"), F.length(text)))

    # The rows' own columns travel in one struct, so that no name can clash.
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    found = _found(docs.select("text", row.alias("row")), "row", "text")
    clean = _let(F.sort_array(F.concat(mine, terms)), rewritten)
    return found.select(*(F.when(text.isNotNull(), clean).alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """Counts and spans of every row of ``docs``."""
    found = _found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,general:boolean>>")
    return found.select(
        "doc_id", *(count(kind).alias(f"n_{kind}") for kind in KINDS[:-1]),
        F.sha2(_joined(_told(F.col("base"), nothing)).cast("binary"), 256).alias("base_sha256"),
        _joined(_told(F.col("base"), F.col("terms"))).alias("spans"),
        F.size(F.filter("terms", lambda t: t["general"])).cast("long").alias("n_generalised"),
        F.size(F.filter("terms", lambda t: ~t["general"])).cast("long").alias("n_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _kind_sql(kind: str, test: str, name: str) -> str:
    pattern = PATTERNS[kind]
    return f""" SELECT r, {KINDS.index(kind)} AS kind, '{kind}:' || {name} AS entity, s AS start, s + len(m) AS "end",
   list_concat(list_slice(p, greatest(len(p) - {CONTEXT - 1}, 1), len(p)), q[1:{CONTEXT}]) AS context
  FROM (SELECT r, found[k] AS m, regexp_extract_all(lower(pieces[k]), '{TERM}') AS p, regexp_extract_all(lower(pieces[k + 1]), '{TERM}') AS q,
    CAST(list_sum(list_transform(pieces[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: len(x))), 0) AS BIGINT) AS s
   FROM (SELECT r, found, pieces, unnest(range(1, len(found) + 1)) AS k FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS found,
     string_split_regex(text, '{pattern}') AS pieces FROM d)))
  WHERE {test}"""


_DIGITS_SQL = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN_SQL = (f"list_sum(list_transform(list_reverse(string_split({_DIGITS_SQL}, '')), lambda x, i: CASE WHEN i % 2 = 1 THEN CAST(x AS INT) "
             "ELSE (2 * CAST(x AS INT)) // 10 + (2 * CAST(x AS INT)) % 10 END)) % 10 = 0")
_STEMS_SQL = "list_distinct(list_concat({0}, list_transform({0}, lambda x: x[1:" + str(STEM) + "] || '*')))"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
 b AS ({" UNION ALL ".join((
    _kind_sql("email", "true", "lower(m)"),
    _kind_sql("ip", "len(list_filter(string_split(m, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0", "m"),
    _kind_sql("card", f"CASE WHEN len({_DIGITS_SQL}) BETWEEN 12 AND 19 THEN {_LUHN_SQL} ELSE false END", _DIGITS_SQL),
    _kind_sql("phone", f"len({_DIGITS_SQL}) BETWEEN 9 AND 15", _DIGITS_SQL)))}),
 c AS (SELECT entity, count(DISTINCT r) AS n_c FROM b GROUP BY entity),
 x AS (SELECT entity, term, count(DISTINCT r) AS n_ct FROM (SELECT r, entity, unnest({_STEMS_SQL.format("context")}) AS term FROM b)
   GROUP BY entity, term HAVING count(DISTINCT r) >= {SUPPORT}),
 t AS (SELECT term, count(*) AS n_t FROM (SELECT unnest({_STEMS_SQL.format(f"regexp_extract_all(lower(text), '{TERM}')")}) AS term FROM d) GROUP BY term),
 n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d),
 i AS (SELECT entity, term, ln(n * n_ct / (n_c * n_t)) / ln(n / n_c) AS disclosure FROM x JOIN t USING (term) JOIN c USING (entity), n WHERE n_c < n),
 a AS (SELECT w.entity, w.term, g.disclosure <= {DISCLOSED} AS general FROM i w LEFT JOIN i g
   ON w.entity = g.entity AND g.term = w.term[1:{STEM}] || '*' WHERE w.disclosure > {DISCLOSED} AND NOT w.term LIKE '%*'),
 h AS (SELECT r, term, bool_and(general) AS general FROM (SELECT DISTINCT r, entity FROM b) JOIN a USING (entity) GROUP BY r, term),
 w AS (SELECT r, found[k] AS m, CAST(list_sum(list_transform(pieces[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(found[1:k - 1],
   lambda x: len(x))), 0) AS BIGINT) AS s FROM (SELECT r, found, pieces, unnest(range(1, len(found) + 1)) AS k FROM (
   SELECT r, regexp_extract_all(text, '{TERM}') AS found, string_split_regex(text, '{TERM}') AS pieces FROM d WHERE r IN (SELECT r FROM h)))),
 u AS (SELECT w.r, s AS start, s + len(m) AS "end", general FROM w JOIN h ON w.r = h.r AND lower(m) = term
   WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = w.r AND b.start < s + len(m) AND s < b."end")),
 o AS (SELECT r, kind, start, "end" FROM b UNION ALL SELECT r, {len(KINDS) - 1}, start, "end" FROM u),
 l AS (SELECT r, string_agg((['{"', '".join(KINDS)}'])[kind + 1] || ':' || start || ':' || "end", ',' ORDER BY start, kind, "end") AS spans,
   coalesce(string_agg((['{"', '".join(KINDS)}'])[kind + 1] || ':' || start || ':' || "end", ',' ORDER BY start, kind, "end")
     FILTER (kind < {len(KINDS) - 1}), '') AS base FROM o GROUP BY r),
 k AS (SELECT r, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{KINDS[k]}" for k in range(len(KINDS) - 1))} FROM b GROUP BY r),
 g AS (SELECT r, count(*) FILTER (general) AS n_generalised, count(*) FILTER (NOT general) AS n_removed FROM u GROUP BY r)
 SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS[:-1])}, sha256(coalesce(base, '')) AS base_sha256,
   coalesce(spans, '') AS spans, coalesce(n_generalised, 0) AS n_generalised, coalesce(n_removed, 0) AS n_removed
 FROM d LEFT JOIN l USING (r) LEFT JOIN k USING (r) LEFT JOIN g USING (r)"""
