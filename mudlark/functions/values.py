"""Text to typed values as native expressions, with the reason where a text has none.

The order is fixed: pointer, trim, replacements, missing words, strip, sign, grouping, separators, decimal shift,
parse. :func:`parse` gives two columns, the value and what is wrong with the text; the caller counts the
second in a verification pass and raises it in a projection.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mudlark.functions.text import utrim
from mudlark.spec import ColumnSpec

#: Boolean words, compared without case.
TRUE = ("true", "1", "yes", "y", "ja", "wahr")
FALSE = ("false", "0", "no", "n", "nein", "falsch")
MONTHS = {m: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)}


def spark_type(c: ColumnSpec) -> T.DataType:
    kinds = {"utf8": T.StringType(), "bool": T.BooleanType(), "int64": T.LongType(), "float64": T.DoubleType(), "date": T.DateType()}
    if c.dtype == "decimal":
        return T.DecimalType(c.precision, c.scale)
    if c.dtype == "timestamp":
        return T.TimestampType() if c.timezone else T.TimestampNTZType()
    return kinds[c.dtype]


def pointer(raw: Column, path: str) -> tuple[Column, Column]:
    """RFC 6901 into JSON text: a scalar as text, null where nothing is there; an object or array is a fault."""
    steps = [s.replace("~1", "/").replace("~0", "~") for s in path.split("/")[1:]]
    tried = [""]
    for s in steps:
        quoted = "['" + s.replace("'", "\\'") + "']"
        tried = [t + q for t in tried for q in ([quoted, f"[{s}]"] if re.fullmatch(r"0|[1-9]\d*", s) else [quoted])]

    def found(doc: Column) -> Column:
        def told(x: Column) -> Column:
            kind = F.schema_of_variant(x)
            nested = F.coalesce(kind.rlike("^(OBJECT|ARRAY)"), F.lit(False))
            text = F.when(F.is_variant_null(x), None).when(kind == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.to_json(x))
            return pair(F.when(~nested, text), F.when(raw.isNotNull() & (raw != "") & doc.isNull(), F.lit("not JSON")).when(nested, F.lit(f"an object or array at {path}")))

        return let(F.coalesce(*[F.try_variant_get(doc, "$" + t, "variant") for t in tried]), told)

    both = let(F.try_parse_json(raw), found)
    return both["v"], both["fault"]


def strftime(fmt: str) -> tuple[str, list[str]]:
    """A strftime format as a pattern, and the item of each group."""
    items = {"Y": r"(\d{4})", "y": r"(\d{2})", "m": r"(\d{1,2})", "d": r"(\d{1,2})", "e": r"\s*(\d{1,2})", "H": r"(\d{1,2})", "M": r"(\d{1,2})", "S": r"(\d{1,2})", "f": r"(\d{1,9})", ".f": r"(?:\.(\d{1,9}))?", "z": r"([+-]\d{2}:?\d{2})", "b": r"([A-Za-z]{3})", "B": r"([A-Za-z]+)", "j": r"(\d{1,3})", "I": r"(\d{1,2})", "p": r"([AaPp][Mm])"}
    out, found = "", []
    for m in re.finditer(r"%%|%(\.f|.)|([^%]+)", fmt.replace("%F", "%Y-%m-%d").replace("%T", "%H:%M:%S")):
        if m[2] is not None:
            out += re.escape(m[2]).replace("\\ ", r"\s+" if m[2] == "  " else " ")
        elif m[0] == "%%":
            out += "%"
        elif m[1] not in items:
            raise ValueError(f"unknown date item %{m[1]} in {fmt!r}")
        else:
            out += items[m[1]]
            found.append(m[1].strip("."))
    return f"^{out}$", found


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    Catalyst puts a named expression wherever its name stands; it can't do so with a lambda's variable.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def iso(text: Column, fmt: str, pivot: int = 70, zone: str | None = None) -> Column:
    """The text as an ISO date and time that a cast reads; null if it doesn't follow the format."""
    pattern, items = strftime(fmt)
    whole = F.split(F.regexp_replace(text, pattern, "|".join(f"${k}" for k in range(1, len(items) + 1))), r"\|")

    def put(parts: Column) -> Column:
        at = lambda k: F.get(parts, F.lit(items.index(k)))
        pad = lambda c: F.lpad(c, 2, "0")
        if "Y" in items:
            year = at("Y")
        elif "y" in items:
            year = F.concat(F.when(at("y") >= f"{pivot:02d}", "19").otherwise("20"), at("y"))
        else:
            year = F.lit("1970")
        if "b" in items or "B" in items:
            word = F.lower(at("B" if "B" in items else "b"))
            month = F.coalesce(*[F.when(word == (m if "B" in items else m[:3]), F.lit(f"{i:02d}")) for m, i in MONTHS.items()])
        else:
            month = pad(at("m")) if "m" in items else F.lit("01")
        day = pad(at("d" if "d" in items else "e")) if "d" in items or "e" in items else F.lit("01")
        hour = pad(at("H")) if "H" in items else F.lit("00")
        if "I" in items:
            twelve = at("I").try_cast("int") % 12 + (F.when(F.lower(at("p")) == "pm", 12).otherwise(0) if "p" in items else 0)
            hour = F.lpad(twelve.cast("string"), 2, "0")
        minute = pad(at("M")) if "M" in items else F.lit("00")
        second = pad(at("S")) if "S" in items else F.lit("00")
        part = F.concat(F.lit("."), F.rpad(F.substring(at("f"), 1, 6), 6, "0")) if "f" in items else F.lit("")
        offset = F.regexp_replace(at("z"), r"^([+-]\d{2}):?(\d{2})$", "$1:$2") if "z" in items else F.lit(zone or "")
        return F.concat(year, F.lit("-"), month, F.lit("-"), day, F.lit("T"), hour, F.lit(":"), minute, F.lit(":"), second, part, offset)

    return F.when(text.rlike(pattern), let(whole, put))


def shifted(text: Column, places: int) -> Column:
    """A plain number with its point moved, on the digits."""
    if not places:
        return text
    n = abs(places)

    def move(parts: Column) -> Column:
        sign, whole, part = (F.get(parts, F.lit(i)) for i in range(3))
        if places > 0:
            moved = F.concat(whole, F.rpad(F.substring(part, 1, n), n, "0"), F.lit("."), F.substring(part, n + 1, 1000))
        else:
            wide = F.concat(F.lit("0" * n), whole)
            moved = let(wide, lambda w: F.concat(F.substring(w, F.lit(1), F.length(w) - n), F.lit("."), F.substring(w, F.length(w) - n + 1, F.lit(n)), part))
        return F.concat(sign, F.regexp_replace(F.regexp_replace(moved, r"^0+(?=\d)", ""), r"\.$", ""))

    number = r"^([+-]?)(\d*)\.?(\d*)$"
    return F.when(text.rlike(number), let(F.split(F.regexp_replace(text, number, "$1|$2|$3"), r"\|"), move)).otherwise(text)


#: From the text so far and what is wrong so far to the same after a step.
Step = Callable[[Column, Column], tuple[Column, Column]]


def cleaning(c: ColumnSpec) -> list[Step]:
    """Steps before the parse: in the end there is the text to parse (null if missing) and what is wrong by then."""
    steps: list[Step] = []
    numeric = c.dtype in ("int64", "float64", "decimal")
    if c.pointer:
        steps.append(lambda v, fault: pointer(v, c.pointer))

    def plain(v: Column, fault: Column) -> tuple[Column, Column]:
        v = utrim(v) if c.trim else v
        for a, b in c.replace:
            v = F.replace(v, F.lit(a), F.lit(b))
        return v, fault

    def missing(v: Column, fault: Column) -> tuple[Column, Column]:
        gone = v == ""
        if c.na_values:
            gone = gone | F.lower(v).isin([x.lower() for x in c.na_values])
        return F.when(~gone, v), fault

    def stripped(v: Column, fault: Column) -> tuple[Column, Column]:
        kept = F.regexp_replace(v, c.strip, "")
        kept = utrim(kept) if c.trim else kept

        def told(k: Column) -> Column:
            lost = (v.rlike(r"^\(.*\)$") | v.rlike(r"[-−]$")) & ~(k.rlike(r"^\(.*\)$") | k.rlike(r"[-−]$"))
            said = F.coalesce(fault, F.when(lost, F.lit("the strip pattern takes a sign away"))) if numeric and not c.negative else fault
            return pair(F.when(k != "", k), said)

        both = let(kept, told)
        return both["v"], both["fault"]

    def signed(name: str, marked: str, bare: str) -> Step:
        def step(v: Column, fault: Column) -> tuple[Column, Column]:
            if c.negative != name:
                return v, F.coalesce(fault, F.when(v.rlike(marked), F.lit(f"a sign marker; declare negative = \"{name}\"")))
            inner = utrim(F.regexp_extract(v, bare, 1))
            two = F.when(inner.rlike(r"^[+-]"), F.lit("two signs"))
            both = F.when(v.rlike(marked), pair(F.concat(F.lit("-"), inner), F.coalesce(fault, two))).otherwise(pair(v, fault))
            return both["v"], both["fault"]

        return step

    def separated(v: Column, fault: Column) -> tuple[Column, Column]:
        point = re.escape(c.decimal or ".")
        if c.thousands in (".", ","):
            t = re.escape(c.thousands)
            fits = v.rlike(rf"^[+-]?(\d{{1,3}}({t}\d{{3}})*|\d+)({point}\d*)?$") | ~v.contains(c.thousands)
            fault = F.coalesce(fault, F.when(~fits, F.lit("digits aren't grouped in threes")))
        if c.thousands:
            v = F.replace(v, F.lit(c.thousands), F.lit(""))
        if c.decimal and c.decimal != ".":
            fault = F.coalesce(fault, F.when(v.contains("."), F.lit("a point where the decimal separator is another")))
            v = F.replace(v, F.lit(c.decimal), F.lit("."))
        return v, fault

    if c.trim or c.replace:
        steps.append(plain)
    steps.append(missing)
    if c.strip:
        steps.append(stripped)
    if numeric:
        steps += [signed("parentheses", r"^\(.*\)$", r"^\((.*)\)$"), signed("trailing_minus", r".[-−]$", r"^(.*)[-−]$")]
        if c.thousands or c.decimal not in (None, "."):
            steps.append(separated)
        if c.decimal_shift:
            steps.append(lambda v, fault: (shifted(v, c.decimal_shift), fault))
    return steps


def pair(v: Column, fault: Column) -> Column:
    return F.struct(v.alias("v"), fault.cast("string").alias("fault"))


def stepped(step: Step) -> Callable[[Column], Column]:
    return lambda s: pair(*step(s["v"], s["fault"]))


def parse(raw: Column, c: ColumnSpec) -> tuple[Column, Column]:
    """The typed value of a cell (null if missing or wrong), and what is wrong with it (null if nothing).

    The steps hand their results on through :func:`let`, so each is computed once a cell.
    """
    both = pair(raw, F.lit(None))
    for step in cleaning(c):
        both = let(both, stepped(step))
    out = let(both, lambda s: finished(s["v"], s["fault"], c))
    return out["value"], out["problem"]


def finished(v: Column, fault: Column, c: ColumnSpec) -> Column:
    """A cleaned text as value and problem."""

    def judged(value: Column, wrong: Callable[[Column], Column]) -> Column:
        def told(x: Column) -> Column:
            problem = F.coalesce(fault, wrong(x))
            if not c.nullable:
                problem = F.coalesce(problem, F.when(v.isNull(), F.lit("a value is missing")))
            return let(problem, lambda p: F.struct(F.when(p.isNull(), x).cast(kind).alias("value"), p.alias("problem")))

        return let(value, told)

    kind = spark_type(c)
    if c.dtype == "utf8":
        return judged(v, lambda x: F.lit(None).cast("string"))
    if c.dtype == "bool":
        low = F.lower(v)
        value = F.when(low.isin([x.lower() for x in c.true_values or TRUE]), True).when(low.isin([x.lower() for x in c.false_values or FALSE]), False)
        return judged(value, lambda x: F.when(v.isNotNull() & x.isNull(), F.lit("not a boolean word")))
    if c.dtype == "int64":
        plain = r"^[+-]?\d+(\.0*)?$" if c.decimal_shift else r"^[+-]?\d+$"
        digits = F.regexp_replace(v, r"\.0*$", "") if c.decimal_shift else v
        return judged(F.when(v.rlike(plain), digits.try_cast("bigint")), lambda x: F.when(v.isNotNull() & x.isNull(), F.when(v.rlike(plain), F.lit("out of range")).otherwise(F.lit("not an integer"))))
    if c.dtype == "float64":
        plain = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

        def kept(number: Column) -> Column:
            lost = (F.abs(number) == float("inf")) | ((number == 0) & v.rlike(r"^[^eE]*[1-9]"))
            return F.when(~lost, number)

        value = let(F.when(v.rlike(plain), v.try_cast("double")), kept)
        return judged(value, lambda x: F.when(v.isNotNull() & x.isNull(), F.when(v.rlike(plain), F.lit("beyond the range of a double")).otherwise(F.lit("not a number"))))
    if c.dtype == "decimal":
        plain = r"^[+-]?(\d+\.?\d*|\.\d+)$"
        excess = F.when(v.rlike(rf"\.\d{{{c.scale}}}\d*[1-9]"), F.lit(f"more than {c.scale} decimal digits")) if c.round == "error" else F.lit(None).cast("string")
        none = F.when(v.rlike(plain), F.lit("too many digits")).otherwise(F.lit("not a plain number"))
        return judged(F.when(v.rlike(plain), v.try_cast(kind)), lambda x: F.when(v.isNotNull(), F.when(x.isNull(), F.when(v.rlike(plain), F.coalesce(excess, none)).otherwise(none)).otherwise(excess)))
    value, wrong = temporal(v, c)
    return judged(value, lambda x: F.when(v.isNotNull() & x.isNull(), F.lit(wrong)))


def temporal(v: Column, c: ColumnSpec) -> tuple[Column, str]:
    """The value of a date or timestamp, and what to say where there is none."""
    kind = spark_type(c)
    if c.epoch in ("seconds", "millis", "micros"):
        unit = {"seconds": 1_000_000, "millis": 1_000, "micros": 1}[c.epoch]
        inside = lambda n: F.when(n.between(F.lit(-62135596800000000), F.lit(253402300799999999)), n).cast("bigint")

        def instant(micros: Column) -> Column:
            if c.dtype == "date":
                return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / F.lit(86_400_000_000)).cast("int"))
            return F.timestamp_micros(micros).cast(kind)

        n = F.when(v.rlike(r"^[+-]?\d{1,18}$"), v.try_cast("decimal(38,0)") * unit)
        return let(let(n, inside), instant), f"not an epoch in {c.epoch}"
    if c.epoch == "excel":
        n = F.when(v.rlike(r"^\d+(\.\d+)?$"), v.try_cast("decimal(30,12)"))

        def serial(n: Column) -> Column:
            day = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(n).cast("int"))
            if c.dtype == "date":
                return F.when(n == F.floor(n), day)
            millis = F.round((n - F.floor(n)) * 86_400_000).cast("bigint")
            return F.timestamp_millis(F.unix_date(day).cast("bigint") * 86_400_000 + millis).cast("timestamp_ntz").cast(kind)

        return let(n, lambda n: F.when(n.between(61, 2958465.999999), serial(n))), "not a whole Excel date" if c.dtype == "date" else "not an Excel date"
    formats = [c.format] if c.format else ["%Y-%m-%d"] if c.dtype == "date" else ["%Y-%m-%dT%H:%M:%S%.f", "%Y-%m-%d %H:%M:%S%.f", "%Y-%m-%d"]
    zone = c.timezone if c.dtype == "timestamp" else None
    pivot = 70 if c.year_pivot is None else c.year_pivot
    texts = [iso(v, f, pivot, None if "%z" in f else zone) for f in formats]
    if c.format and c.dtype == "timestamp":
        texts.append(iso(v, c.format.split("T")[0].split(" ")[0], pivot, zone)) if re.search(r"%[HIM]", c.format) and re.search(r"%[Yy]", c.format.split("T")[0].split(" ")[0]) else None
    if c.dtype == "date":
        value = F.coalesce(*[F.substring(t, 1, 10).try_cast("date") for t in texts])
    else:
        value = F.coalesce(*[t.try_cast(kind) for t in texts])
    return value, f"doesn't follow {c.format or 'ISO'}"
