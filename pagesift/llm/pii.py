"""Personal data by information-theoretic sanitisation (DataFrame operations only).

Patterns find the protected entities: e-mail addresses, IPv4 addresses, card numbers that
pass Luhn's test, and phone numbers. Masking them is not enough if the words around them give them
away, so the corpus is asked how strongly a term reveals an entity. With n(x) the number of
distinct texts that hold x, N all of them and c those that hold term t within ``WINDOW`` characters of
entity e, the pointwise mutual information ln(N c / (n(t) n(e))) is compared with the entity's own
information ln(N / n(e)): their quotient, the disclosure, is 1 if the term is never seen without the
entity and falls to 0 as it gets independent of it. A term that has a disclosure of ``GENERALISE`` or
more for some entity is generalised wherever it stands, from ``REMOVE`` on it is removed. An entity that
fewer than ``SUPPORT`` distinct texts share with the term tells nothing about it, so copies alone, or one
text, condemn no word.

Contexts are bounded by the window, so an entity gives a bounded number of terms, and pairs of
term and entity are counted and never joined among each other. Only terms whose disclosure
can still reach the threshold (c is known, and the texts in which the term stands near any entity are a lower
bound of n(t)) are counted in the whole corpus. Places come from the lengths of matches and of the text
between them.

The kinds of a span are ``email``, ``ip``, ``card``, ``phone``, then ``generalised`` and ``removed`` for terms.
Terms are runs of letters, marks and digits in lower case, outside of base spans.

Defined cases: null text is empty; texts of any length are read whole; a null id is passed on and
rows that repeat an id are rows of their own; equal texts get equal spans; an empty table gives no rows; other
columns are not read, ``sanitise`` passes them on whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.llm.common import fresh, join_checked, let, materialize

KINDS = ["email", "ip", "card", "phone", "generalised", "removed"]
GENERALISE, REMOVE, SUPPORT, WINDOW = 0.95, 0.99, 3, 80
#: The base patterns. A run that can't start a match is left at once, and what has matched
#: is not given back, which changes no match but keeps long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}\p{M}\p{N}]++"
_BLOCK = 6  # log2 of the block length of running sums
_NONE = "cast(array() as array<struct<start:bigint,kind:int,end:bigint,value:string>>)"


def _running(values: Column, add, start: Column) -> Column:
    """Inclusive running totals of an array. Blocks are totalled first, so n values take about
    n 2^6 + (n / 2^6)^2 / 2 steps and no window over rows."""
    total = lambda a: F.aggregate(a, start, add)
    width = 1 << _BLOCK

    def done(a: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.greatest(F.shiftright(F.size(a) - 1, _BLOCK), F.lit(0))), lambda b: total(F.slice(a, b * width + 1, F.lit(width))))
        before = lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda b: total(F.slice(s, F.lit(1), b)))
        own = lambda x, i: total(F.slice(a, F.shiftleft(F.shiftright(i, _BLOCK), _BLOCK) + 1, i.bitwiseAND(width - 1) + 1))
        return let(sums, lambda s: let(before(s), lambda p: F.transform(a, lambda x, i: add(p[F.shiftright(i, _BLOCK)], own(x, i)))))

    return let(values, done)


def matches(text: Column, pattern: str, kind: int, keep) -> Column:
    """``start, kind, end, value`` of the pattern's matches whose value ``keep`` accepts, in code points."""

    def placed(m: Column, gaps: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, v: (F.length(g) + F.length(v)).cast("long"))
        ends = _running(steps, lambda x, y: x + y, F.lit(0).cast("long"))
        spans = F.zip_with(m, ends, lambda v, e: F.struct((e - F.length(v)).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), v.alias("value")))
        return F.filter(spans, lambda s: keep(s["value"]))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gaps"))
    return let(both, lambda b: placed(b["m"], b["gaps"]))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def value(i: Column) -> Column:  # the i-th digit from the right
        digit = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda t, i: t + value(i)) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """The protected entities of a text, by start, then kind."""
    small = r"\A(?:0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]{0,2})(?:\.|\z)){4}\z"
    card = lambda v: let(_digits(v), lambda d: F.length(d).between(14, 19) & luhn(d))
    kinds = [
        (F.contains(text, F.lit("@")), EMAIL, lambda v: F.lit(True)),
        (text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), IP, lambda v: v.rlike(small)),
        (text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), CARD, card),
        (F.contains(text, F.lit("+")), PHONE, lambda v: F.length(_digits(v)).between(10, 15)),
    ]
    return F.array_sort(F.concat(*[F.when(may, matches(text, pattern, kind, keep)).otherwise(F.expr(_NONE)) for kind, (may, pattern, keep) in enumerate(kinds)]))


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def contexts(text: Column, window: int = WINDOW) -> Column:
    """``entity, terms`` of each base span: terms within the window before and after it. The
    outermost word of a side that is cut is left out, as it may be part of a longer one."""

    def around(s: Column) -> Column:
        before = F.regexp_extract_all(F.substring(text, F.greatest(s["start"] - window, F.lit(0)).cast("int") + 1, F.least(s["start"], F.lit(window)).cast("int")), F.lit(TERM), F.lit(0))
        after = F.regexp_extract_all(F.substring(text, s["end"].cast("int") + 1, F.lit(window)), F.lit(TERM), F.lit(0))
        before = let(before, lambda w: F.when(s["start"] > window, F.slice(w, F.lit(2), F.size(w))).otherwise(w))
        after = let(after, lambda w: F.when((s["end"] + window < F.length(text)) & (F.size(w) > 0), F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0)))).otherwise(w))
        plain = F.when(s["kind"].isin(2, 3), _digits(s["value"])).otherwise(F.lower(s["value"]))
        return F.struct(F.concat_ws(":", s["kind"], plain).alias("entity"), F.array_distinct(F.transform(F.concat(before, after), F.lower)).alias("terms"))

    return let(base_spans(text), lambda base: F.transform(base, around))


def revealing_terms(docs: DataFrame, text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT, window: int = WINDOW) -> DataFrame:
    """``key, terms``: for each distinct text (by its digest) that holds any, its terms which give an
    entity away, as ``term, removed, disclosure``."""
    text = _text(text_col)
    marked = materialize(docs.select(_key(text).alias("key"), F.when(text != "", contexts(text, window)).alias("contexts")), "pii-contexts")
    n_texts = float(marked.where("contexts is not null").select("key").distinct().count() or 1)
    near = marked.select("key", F.explode("contexts").alias("c")).select("key", "c.*")
    per_entity = near.select("entity", "key").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    near = near.select("entity", "key", F.explode("terms").alias("term")).distinct()
    at_least = near.select("term", "key").distinct().groupBy("term").agg(F.count("*").alias("n_near"))
    own = F.log(F.lit(n_texts) / F.col("n_e"))
    disclosure = lambda n_t: 1 - F.log(n_t / F.col("c")) / own
    pairs = near.groupBy("term", "entity").agg(F.count("*").alias("c")).where(F.col("c") >= support)
    pairs = pairs.join(per_entity, "entity").where(F.col("n_e") < n_texts).join(at_least, "term")
    pairs = materialize(pairs.where(disclosure(F.col("n_near")) >= generalise).select("term", "c", "n_e"), "pii-pairs")
    terms = materialize(pairs.select("term").distinct(), "pii-terms")

    words = docs.select(_key(text).alias("key"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))).alias("term"))
    held = materialize(join_checked(words, terms, "term", "left_semi").distinct(), "pii-held")
    counted = held.groupBy("term").agg(F.count("*").alias("n_t"))
    judged = pairs.join(counted, "term").groupBy("term").agg(F.max(disclosure(F.col("n_t"))).alias("disclosure")).where(F.col("disclosure") >= generalise)
    judged = materialize(judged.select("term", (F.col("disclosure") >= remove).alias("removed"), "disclosure"), "pii-judged")
    return join_checked(held, judged, "term").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("term", "removed", "disclosure"))).alias("terms"))


def _term_spans(text: Column, base: Column, terms: Column) -> Column:
    """Where a text's revealing terms stand outside of its base spans."""
    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    def spans(listed: Column) -> Column:
        known, gone = listed["known"], listed["gone"]
        found = F.filter(matches(text, TERM, 4, lambda v: F.array_contains(known, F.lower(v))), free)
        return F.transform(found, lambda s: s.withField("kind", F.when(F.array_contains(gone, F.lower(s["value"])), 5).otherwise(4)))

    removed = F.transform(F.filter(terms, lambda t: t["removed"]), lambda t: t["term"])
    return let(F.struct(F.transform(terms, lambda t: t["term"]).alias("known"), removed.alias("gone")), spans)


def _with_spans(docs: DataFrame, text_col: str, **how) -> tuple[DataFrame, str, str]:
    """``docs`` with a column of base spans and one of all spans, and the two columns' names."""
    text = _text(text_col)
    key, terms, base, spans = (fresh(docs, f"pii_{n}") for n in ("key", "terms", "base", "spans"))
    hints = materialize(revealing_terms(docs, text_col, **how), "pii-hints").select(F.col("key").alias(key), F.col("terms").alias(terms))
    rows = join_checked(docs.withColumn(key, _key(text)), hints, key, "left")
    rows = rows.withColumn(base, base_spans(text))
    more = F.when(F.col(terms).isNotNull(), _term_spans(text, F.col(base), F.col(terms))).otherwise(F.expr(_NONE))
    return rows.withColumn(spans, F.array_sort(F.concat(base, more))).drop(key, terms), base, spans


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row."""
    rows, base, spans = _with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", **how)
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return rows.select("doc_id", *[of(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(_listed(F.col(base)), 256).alias("base_sha256"), _listed(F.col(spans)).alias("spans"))


def sanitise(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """``docs`` with sanitised texts: entities become their kind in brackets, generalised terms
    ``[number]``, ``[name]`` (capitalised) or ``[word]``, removed terms go. Where spans overlap, all that
    any of them covers goes."""
    text = _text(text_col)
    rows, _, spans = _with_spans(docs, text_col, **how)
    kinds = F.array(*[F.lit(f"[{k}]") for k in KINDS[:4]])

    def instead(s: Column) -> Column:
        shape = F.when(s["value"].rlike(r"\A\p{N}+\z"), "[number]").when(s["value"].rlike(r"\A\p{Lu}"), "[name]").otherwise("[word]")
        return F.when(s["kind"] < 4, kinds[s["kind"]]).when(s["kind"] == 4, shape).otherwise(F.lit(""))

    def rebuilt(spans: Column) -> Column:
        upto = _running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0).cast("long"))

        def pieces(ends: Column) -> Column:
            start = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0).cast("long"))
            piece = lambda s, i: F.when(s["start"] >= start(i), F.concat(F.substring(text, start(i).cast("int") + 1, (s["start"] - start(i)).cast("int")), instead(s))).otherwise("")
            return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, F.element_at(ends, -1).cast("int") + 1, F.length(text)))

        return let(upto, pieces)

    clean = F.when(F.size(spans) > 0, rebuilt(F.col(spans))).otherwise(F.col(text_col))
    return rows.withColumn(text_col, clean).select(*docs.columns)


def _oracle() -> str:
    """DuckDB SQL for :func:`find_pii` over ``documents``, with the patterns as stated."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    term = r"[\p{L}\p{M}\p{N}]+"

    def raw(kind: int, pattern: str, table: str = "d", where: str = "true") -> str:
        lists = f"SELECT r, t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM {table} WHERE {where}"
        rows = f"SELECT r, t, unnest(m) AS v, unnest(g[:len(m)]) AS gap, unnest(range(len(m))) AS i FROM ({lists})"
        return f"SELECT r, t, {kind} AS kind, v, sum(length(gap) + length(v)) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM ({rows})"

    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    doubled = f"list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN substr({digits}, length({digits}) - i, 1)::INT ELSE substr('0246813579', substr({digits}, length({digits}) - i, 1)::INT + 1, 1)::INT END))"
    names = "['" + "','".join(KINDS) + "'][kind + 1]"
    listed = f"coalesce(string_agg(concat_ws(':', {names}, s, e), ',' ORDER BY s, kind) FILTER (s IS NOT NULL), '')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(raw(i, p) for i, p in enumerate(patterns.values()))}),
base AS (
  SELECT r, t, kind, v, e - length(v) AS s, e FROM raw
  WHERE kind = 0 OR (kind = 1 AND list_max(list_transform(string_split(v, '.'), lambda x: x::HUGEINT)) <= 255)
     OR (kind = 2 AND length({digits}) BETWEEN 14 AND 19 AND {doubled} % 10 = 0) OR (kind = 3 AND length({digits}) BETWEEN 10 AND 15)
),
near AS (
  SELECT t, kind || ':' || CASE WHEN kind IN (2, 3) THEN {digits} ELSE lower(v) END AS entity,
         regexp_extract_all(substr(t, greatest(s - {WINDOW}, 0) + 1, least(s, {WINDOW})), '{term}')[CASE WHEN s > {WINDOW} THEN 2 ELSE 1 END:] AS a,
         regexp_extract_all(substr(t, e + 1, {WINDOW}), '{term}') AS b, e + {WINDOW} < length(t) AS cut
  FROM base
),
seen AS (SELECT DISTINCT t, entity, lower(unnest(a || CASE WHEN cut THEN b[:-2] ELSE b END)) AS term FROM near),
n AS (SELECT count(DISTINCT t)::DOUBLE AS n FROM d WHERE t <> ''),
e AS (SELECT entity, count(DISTINCT t) AS n_e FROM near GROUP BY entity),
pairs AS (SELECT term, c, n_e FROM (SELECT term, entity, count(*) AS c FROM seen GROUP BY ALL) JOIN e USING (entity), n WHERE c >= {SUPPORT} AND n_e < n),
held AS (SELECT term, count(DISTINCT t) AS n_t FROM (SELECT t, unnest(list_distinct(regexp_extract_all(lower(t), '{term}'))) AS term FROM d) WHERE term IN (SELECT term FROM pairs) GROUP BY term),
judged AS (SELECT term, max(1 - ln(n_t / c) / ln(n / n_e)) AS disclosure FROM pairs JOIN held USING (term), n GROUP BY term HAVING max(1 - ln(n_t / c) / ln(n / n_e)) >= {GENERALISE}),
found AS (
  SELECT w.r, CASE WHEN disclosure >= {REMOVE} THEN 5 ELSE 4 END AS kind, w.e - length(w.v) AS s, w.e
  FROM ({raw(4, term, where="EXISTS (SELECT 1 FROM judged WHERE contains(lower(t), term))")}) w JOIN judged ON lower(w.v) = judged.term
),
spans AS (SELECT r, kind, s, e FROM base UNION ALL SELECT r, kind, s, e FROM found f WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = f.r AND b.s < f.e AND f.s < b.e))
SELECT any_value(doc_id) AS doc_id, {", ".join(f"count(*) FILTER (kind = {i})::BIGINT AS n_{k}" for i, k in enumerate(KINDS[:4]))},
       sha256({listed.replace("s IS NOT NULL", "kind < 4")}) AS base_sha256, {listed} AS spans
FROM d LEFT JOIN spans USING (r) GROUP BY r
"""


ORACLE = _oracle()
