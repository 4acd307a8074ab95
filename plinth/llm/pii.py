"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their score.

Everything runs in DataFrame functions. The expressions are anchored to the left
edge of what they scan and bounded or possessive, so they take linear time and find
the leftmost non-overlapping matches of the plain forms named beside them. Positions
come from the lengths of what lies between the matches; offsets are code points,
ends exclusive. Whole words within CONTEXT code points before or after a span raise
its score or lower it. Spans of the base kinds (email, ip, card, phone) always stay;
the others stay from a score of THRESHOLD on: an account number that passes its
checksum unless the words around speak against it, a social security number only
where they speak for it.

Defined results: null or empty text has no spans; a very long text is searched
whole, in the row's own memory; repeated rows give a result each; a null doc_id
stays null; an empty table gives an empty result. Other columns of the input,
whatever their names, are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import let, packed, text_of

SPAN = "array<struct<kind:string,start:int,end:int,value:string,score:double>>"
#: Code points before and after a span that are searched for context words, what those for it add to its score, and those against it take.
CONTEXT, BOOST, DOUBT, THRESHOLD = 40, 0.2, 0.3, 0.5
# Length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GI": 23,
    "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28,
    "PT": 25, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}


def luhn(value: Column) -> Column:
    """13 to 19 digits, between spaces and hyphens, whose Luhn sum is a multiple of ten."""

    def check(digits: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
            return total + F.when(d > 9, d - 9).otherwise(d)

        return F.length(digits).between(13, 19) & (F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0)

    return let(F.translate(value, " -", ""), check)


def mod97(value: Column) -> Column:
    """An IBAN without spaces whose number leaves 1 when divided by 97."""

    def check(turned: Column) -> Column:
        def add(rest: Column, i: Column) -> Column:
            c = F.ascii(F.substring(turned, i, F.lit(1)))
            return F.when(c < 65, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97).cast("int")

        return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1

    return let(F.concat(F.substring(value, 5, 1000), F.substring(value, 1, 4)), check)


def iban(value: Column) -> Column:
    """The part of a proposal that is an IBAN of its country's length, in one piece or in groups of four; null where there is none."""
    length = F.create_map(*(F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair))[F.substring(value, 1, 2)]

    def cut(n: Column) -> Column:
        part = F.substring(value, F.lit(1), n)
        ends = (F.length(value) == n) | (F.contains(value, F.lit(" ")) & (F.substring(value, n + 1, F.lit(1)) == " "))
        return F.when(ends & mod97(F.replace(part, F.lit(" "), F.lit(""))), part)

    return let(length + F.when(F.contains(value, F.lit(" ")), F.floor((length - 1) / F.lit(4)).cast("int")).otherwise(0), cut)


def social(value: Column) -> Column:
    """Not of an area, group or serial number that is never given out."""
    return F.when(~value.rlike("^(000|666|9)") & ~value.rlike("-00-") & ~value.rlike("-0000$"), value)


def when_valid(check: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda value: F.when(check(value), value)


def octets(value: Column) -> Column:
    return value.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})){3}$")


def phone_digits(value: Column) -> Column:
    return F.length(F.translate(value, "+ ().-", "")).between(9, 15)


class Kind(NamedTuple):
    name: str
    java: str
    confirmed: Callable[[Column], Column]
    score: float
    context: str
    against: str
    needs: str


#: In the order in which spans are listed. ``confirmed``: the part of a match that counts, null for none; ``context`` and ``against``:
#: words that raise and lower the score; ``needs``: a character without which the expression can't match.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda v: v, 0.7, "e?-?mail|contact|write|reach", "example", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", when_valid(octets), 0.6, "ip|host|address|server", "version|release|section", "."),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", when_valid(luhn), 0.7, "card|visa|credit|payment", "order|tracking|isbn", ""),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", when_valid(phone_digits), 0.6, "phone|tel|call|mobile", "fax", "+"),
    Kind("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9_])", iban, 0.7, "iban|account|bank|konto|transfer", "serial|part|model|order|sku|licen[cs]e|key", ""),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", social, 0.4, "ssn|social|security", "order|part|serial|invoice|ticket|phone", "-"),
)
BASE = ("email", "ip", "card", "phone")


def _of_kind(text: Column, kind: Kind) -> Column:
    regex = F.lit(kind.java)
    none = F.array().cast(SPAN)

    def scored(start: Column, value: Column) -> Column:
        end = start + F.length(value)
        before = F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))

        def judged(near: Column) -> Column:
            def says(words: str, by: float) -> Column:
                return F.when(near.rlike(rf"(?i)(?<![a-z0-9_])({words})(?![a-z0-9_])"), by).otherwise(0.0)

            score = F.round(kind.score + says(kind.context, BOOST) - says(kind.against, DOUBT), 2)
            return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"), score.alias("score"))

        return let(F.concat(before, F.lit("\n"), F.substring(text, end + 1, F.lit(CONTEXT))), judged)

    def placed(matches: Column, pieces: Column) -> Column:
        def add(seen: Column, x: Column) -> Column:
            start = seen["at"] + x["gap"]
            part = kind.confirmed(x["value"])
            out = let(part, lambda v: F.when(v.isNotNull(), F.concat(seen["out"], F.array(scored(start, v)))).otherwise(seen["out"]))
            return F.struct((start + F.length(x["value"])).alias("at"), out.alias("out"))

        pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda a, b: F.struct(F.length(a).alias("gap"), b.alias("value")))
        all_ = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), add)["out"]
        return all_ if kind.name in BASE else F.filter(all_, lambda s: s["score"] >= THRESHOLD)

    found = let(F.regexp_extract_all(text, regex, F.lit(0)), lambda m: F.when(F.size(m) > 0, let(F.split(text, kind.java, -1), lambda p: placed(m, p))).otherwise(none))
    return F.when(F.contains(text, F.lit(kind.needs)), found).otherwise(none) if kind.needs else found


def spans(text: Column) -> Column:
    """All spans of a text without nulls, by kind as listed, then start."""
    return F.concat(*(_of_kind(text, kind) for kind in KINDS))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row: kind, start, end, value and score of each span."""
    rows = docs.select("doc_id", text_of(docs).alias("text"))
    return rows.select("doc_id", spans(F.col("text")).alias("spans"))


def _shown(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame) -> DataFrame:
    """The counts of each base kind, the digest of the base spans, all spans, and their scores in percent, from the rows of ``find``."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = (count(kind) for kind in BASE)
    base = _shown(F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    scores = F.array_join(F.transform("spans", lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of its text replaced by its kind in brackets; overlapping spans become one, of the first's kind.

    Where the text changes, a column n_chars, if there is one, gets the new length.
    """

    def rebuilt(text: Column, found: Column) -> Column:
        def add(seen: Column, s: Column) -> Column:
            fresh = s["start"] >= seen["at"]
            kept = F.concat(seen["out"], F.substring(text, seen["at"] + 1, s["start"] - seen["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.struct(F.greatest(seen["at"], s["end"]).alias("at"), F.when(fresh, kept).otherwise(seen["out"]).alias("out"))

        ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"], s["end"], s["kind"])))
        none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return let(F.aggregate(ordered, none, add), lambda x: F.concat(x["out"], F.substring(text, x["at"] + 1, F.length(text))))

    rows = packed(docs, "text").withColumn("text", F.col("text").cast("string"))
    new = let(spans(F.coalesce("text", F.lit(""))), lambda s: F.when(F.size(s) > 0, rebuilt(F.col("text"), s)))
    rows = rows.select("row", "text", new.alias("new"))

    def column(name: str) -> Column:
        old = F.col("row").getField(name)
        if name == "text":
            return F.coalesce("new", "text")
        if name == "n_chars":
            return F.when(F.col("new").isNotNull(), F.length("new").cast(docs.schema[name].dataType)).otherwise(old)
        return old

    return rows.select(*(column(name).alias(name) for name in docs.columns))


def _sql() -> str:
    """DuckDB SQL for op4. Social security numbers are whole runs of digits and hyphens here."""
    lengths = "case substr(v, 1, 2) " + " ".join(f"when '{k}' then {n}" for k, n in IBAN_LENGTHS.items()) + " end"
    plain = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_max(list_transform(string_split(v, '.'), lambda x: x::hugeint)) <= 255"),
        "card": (r"[0-9]([ -]?[0-9])+", "length(translate(v, ' -', '')) between 13 and 19 and luhn(translate(v, ' -', '')) % 10 = 0"),
        "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "length(regexp_replace(v, '[^0-9]', '', 'g')) between 9 and 15"),
        "iban": (r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b", "mod97(v) = 1"),
        "ssn": (r"[0-9-]+", "regexp_full_match(v, '[0-9]{3}-[0-9]{2}-[0-9]{4}') and not regexp_matches(v, '^(000|666|9)|-00-|-0000$')"),
    }
    luhn_sql = (
        "list_sum(list_transform(range(1, length(v) + 1), lambda i: case when i % 2 = 1 then substr(v, -i, 1)::int"
        " when substr(v, -i, 1)::int > 4 then 2 * substr(v, -i, 1)::int - 9 else 2 * substr(v, -i, 1)::int end))"
    )
    mod_sql = (
        "list_reduce(list_prepend(0, list_transform(range(1, length(w) + 1), lambda i: ascii(substr(w, i, 1)))),"
        " lambda r, c: case when c < 65 then (r * 10 + c - 48) % 97 else (r * 100 + c - 55) % 97 end)"
    )
    cut = f"substr(v, 1, {lengths} + case when contains(v, ' ') then ({lengths} - 1) // 4 else 0 end)"
    parts = []
    for at, kind in enumerate(KINDS):
        regex, valid = plain[kind.name]
        valid = valid.replace("luhn(translate(v, ' -', ''))", luhn_sql.replace("v", "translate(v, ' -', '')"))
        valid = valid.replace("mod97(v)", mod_sql.replace("(w", "((substr(replace(v, ' ', ''), 5) || substr(v, 1, 4))"))
        part, whole = ("v", "true") if kind.name != "iban" else (f"case when length({cut}) = length(v) or contains(v, ' ') and substr(v, length({cut}) + 1, 1) = ' ' then {cut} end", f"{cut} is not null")
        near = f"substr(t, greatest(s - {CONTEXT}, 0) + 1, least(s, {CONTEXT})) || chr(10) || substr(t, s + length(v) + 1, {CONTEXT})"
        score = f"{kind.score} + case when regexp_matches({near}, '(?i)\\b({kind.context})\\b') then {BOOST} else 0 end - case when regexp_matches({near}, '(?i)\\b({kind.against})\\b') then {DOUBT} else 0 end"
        parts.append(f"""
  select rid, {at} k, '{kind.name}' kind, s, s + length(v) e, round(100 * ({score}))::int p from (
    select rid, t, s, {part} v from (
      select rid, t, v, (sum(length(v) + length(g)) over (partition by rid order by i) - length(v))::bigint s from (
        select rid, t, unnest(m) v, unnest(list_slice(p, 1, len(m))) g, unnest(range(1, len(m) + 1)) i from (
          select rid, t, regexp_extract_all(t, '{regex}') m, regexp_split_to_array(t, '{regex}') p from base)))
    where {whole}
  ) where v is not null and {valid}""" + ("" if kind.name in BASE else f" and {score} >= {THRESHOLD} - 0.001"))
    is_base = "kind in ('" + "', '".join(BASE) + "')"
    counts = ", ".join(f"count(kind) filter (where kind = '{k}')::bigint n_{k}" for k in BASE)
    one = "kind || ':' || s || ':' || e"
    return f"""
with base as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents
), found as ({" union all ".join(parts)})
select doc_id, {counts}, sha256(coalesce(string_agg({one}, ',' order by k, s) filter (where {is_base}), '')) base_sha256,
  coalesce(string_agg({one}, ',' order by k, s), '') spans, coalesce(string_agg(p::varchar, ',' order by k, s), '') scores
from base left join found using (rid) group by rid, doc_id"""


SQL = _sql()
