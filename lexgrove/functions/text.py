"""Column functions on text. Positions count code points; patterns are in the dialect that Java and RE2 share unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[ \t\r\n]+"


def collapsed(text: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def visible(fragment: Column) -> Column:
    """Markup as spaces, the five predefined references resolved (the ampersand last), white space collapsed."""
    bare = F.regexp_replace(fragment, "<[^>]+>", " ")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(name), F.lit(mark))
    return collapsed(bare)


def normalised(value: Column) -> Column:
    """A free-text token as it is compared: characters of category C dropped, compatibility forms resolved (NFKC), trimmed, case-folded; null if
    nothing is left. ASCII stays in the JVM; only other values go through Arrow, a column at a time."""
    bare = F.regexp_replace(value, r"\p{C}", "")
    plain = ~bare.rlike(r"[^\x00-\x7F]")

    @F.pandas_udf("string")
    def folded(s):
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = pc.utf8_normalize(pa.Array.from_pandas(s, type=pa.string()), "NFKC").to_pandas()
        return whole.str.strip().str.casefold()

    return F.nullif(F.when(plain, F.lower(F.trim(bare))).otherwise(folded(F.when(~plain, bare))), F.lit(""))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def digest(text: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, length)


def clause_id(kind: str, text: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), digest(collapsed(F.lower(text)), 12))


def excerpt(text: Column, most: int) -> Column:
    """(excerpt, truncated)."""
    whole = collapsed(text)
    return F.struct(F.substring(whole, 1, most).alias("excerpt"), (F.length(whole) > most).alias("truncated"))


def quoted_in(quote: Column, text: Column) -> Column:
    """Whether a quote that isn't blank stands in the text, white space aside."""
    return (F.length(collapsed(quote)) > 0) & F.contains(collapsed(text), collapsed(quote))


#: Shapes of credentials. A deployment's own key prefixes are given as further shapes.
SECRETS = (r"sk-[A-Za-z0-9_-]{8,}", r"Bearer [A-Za-z0-9._-]{8,}")


def key_shape(prefix: str) -> str:
    """The shape of keys that begin with this prefix."""
    return re.escape(prefix) + "[A-Za-z0-9_-]{8,}"


def scrubbed(text: Column, shapes: tuple[str, ...] = SECRETS) -> Column:
    for shape in shapes:
        text = F.regexp_replace(text, shape, "[redacted]")
    return text


def segment(identifier: Column, n: int) -> Column:
    """The n-th (from 0) part of a path-like identifier, null beyond its end."""
    return F.get(F.split(identifier, ":"), F.lit(n))


def suffix(identifier: Column) -> Column:
    """What follows the first colon; all of it without one."""
    at = F.locate(":", identifier)
    return F.when(at > 0, F.substring(identifier, at + F.lit(1), F.length(identifier))).otherwise(identifier)


def ancestors(identifier: Column) -> Column:
    """The identifier's prefixes that end before a colon, and itself, shortest first."""
    parts = F.split(identifier, ":")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), ":"))


def roman(number: Column) -> Column:
    """Roman numeral of 1 to 3999."""
    out = F.lit("")
    for base, one, five, ten in ((1000, "M", "", ""), (100, "C", "D", "M"), (10, "X", "L", "C"), (1, "I", "V", "X")):
        digit = F.floor(number / base) % 10
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        out = F.concat(out, F.element_at(F.array(*[F.lit(x) for x in forms]), (digit + 1).cast("int")))
    return out


def from_roman(numeral: Column) -> Column:
    """Value of a Roman numeral: a sign before a greater one counts negatively."""
    value = F.create_map(*[F.lit(x) for pair in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000), strict=True) for x in pair])
    signs = F.transform(F.filter(F.split(F.upper(numeral), ""), lambda x: x != ""), lambda x: value[x])
    state = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    step = lambda s, x: F.struct((s["sum"] + x - F.when(s["last"] < x, 2 * s["last"]).otherwise(0)).alias("sum"), x.alias("last"))
    return F.aggregate(signs, state, step, lambda s: s["sum"])


def literal(value: Column) -> Column:
    """A string as an N-Triples literal."""
    for mark, written in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        value = F.replace(value, F.lit(mark), F.lit(written))
    return F.concat(F.lit('"'), value, F.lit('"'))


def term(value: Column, language: Column | None = None, datatype: Column | None = None) -> Column:
    """A literal with its language tag, else its datatype; the datatype of plain strings is left out."""
    string = "http://www.w3.org/2001/XMLSchema#string"
    none = F.lit(None).cast("string")
    tag, kind = none if language is None else F.nullif(language, F.lit("")), none if datatype is None else F.nullif(datatype, F.lit(""))
    return F.concat(literal(value), F.when(tag.isNotNull(), F.concat(F.lit("@"), tag)).when(kind.isNotNull() & (kind != string), F.concat(F.lit("^^<"), kind, F.lit(">"))).otherwise(""))


def json_object(text: Column, schema: str) -> Column:
    """The object in a reply, with or without a code fence around it; null if it can't be read."""
    bare = F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*[ \t\r\n]*|[ \t\r\n]*```$", "")
    return F.when(bare.startswith("{"), F.from_json(bare, schema))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of arrays without repeats; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))
