"""Column functions: predicates, vectors as arrays, probability vectors, formats. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the domain: ordered macro labels, ordered severities, accepted spellings of true.
MACROS = ("A0", "A1", "B", "C")
SEVERITIES = ("NONE", "MINOR", "HOSPITALIZED", "FATAL")
TRUE_WORDS = ("true", "1", "yes", "t")
EPS = 1e-12


def tolerant_bool(c: Column) -> Column:
    """P1. True for true, 1, yes, t in any case and with outer blanks; anything else, null and 1.0 included, is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def is_macro(c: Column) -> Column:
    """P2. One of the macro labels, exactly."""
    return F.coalesce(c.isin(*MACROS), F.lit(False))


def macro_code(c: Column, unknown: int | None = None) -> Column:
    """P3, P4. 0 to 3 by label; unknown labels give null, or the number given for them."""
    out = F.array_position(F.array(*map(F.lit, MACROS)), c).cast("int") - 1
    return F.when(out >= 0, out).otherwise(F.lit(unknown).cast("int"))


def macro_name(c: Column) -> Column:
    return F.get(F.array(*map(F.lit, MACROS)), c)


def valid_text(c: Column) -> Column:
    """P8. Not null, not blank, not the word nan."""
    return F.coalesce((F.trim(c) != "") & (F.lower(F.trim(c)) != "nan"), F.lit(False))


def valid_label(c: Column) -> Column:
    """P9. A label as text that isn't empty, nan or none."""
    return F.coalesce(~F.lower(F.trim(c.cast("string"))).isin("", "nan", "none"), F.lit(False))


def one_hot(c: Column, n: int) -> Column:
    """P10."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == c).cast("int"))


def argmax(p: Column) -> Column:
    """P11. Place of the first largest element, from 0."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def confident(c: Column | None, least: float) -> Column:
    """P12. Confidence of at least `least`; null is not; without such a column all are."""
    return F.lit(True) if c is None else F.coalesce((c >= least) & ~F.isnan(c), F.lit(False))


def outlier_topic(c: Column) -> Column:
    """P13. -1, or a name that ends with _-1."""
    return c.cast("string").rlike("(^-1|_-1)$")


def total(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def let(x: Column, f) -> Column:
    """f of x, with x evaluated once: inside f it is a variable of a lambda, not an expression that is repeated."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalised(v: Column, eps: float = EPS) -> Column:
    """P17. Each element divided by the length, which counts as eps at least."""
    return let(F.greatest(norm(v), F.lit(eps)), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def softmax(v: Column) -> Column:
    def shares(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(e, lambda x: x / total))

    return let(v, lambda w: let(F.array_max(w), lambda top: let(F.transform(w, lambda x: F.exp(x - top)), shares)))


def entropy(p: Column, eps: float = 1e-12) -> Column:
    """A16. In nats; probabilities count as eps at least inside the logarithm."""
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - x * F.ln(F.greatest(x, F.lit(eps))))


def severity_rank(c: Column) -> Column:
    """H14. 0 to 3 by severity in any case; unknown and null are 0."""
    at = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.upper(F.trim(c))).cast("int") - 1
    return F.greatest(F.coalesce(at, F.lit(0)), F.lit(0))


def severity_name(c: Column) -> Column:
    """H14. The severity of a rank, ranks outside 0 to 3 moved to the nearest."""
    return F.get(F.array(*map(F.lit, SEVERITIES)), F.least(F.greatest(c.cast("int"), F.lit(0)), F.lit(len(SEVERITIES) - 1)))


def topic_variable(z: Column, macro: Column) -> Column:
    """H13. Z_07_A1."""
    return F.format_string("Z_%02d_%s", z.cast("int"), macro)


def topic_of_variable(name: Column) -> Column:
    """H13. The topic number of such a name; null for other names."""
    m = F.regexp_extract(name, r"^Z_(\d+)_", 1)
    return F.when(m != "", m.cast("int"))


def bar(p: Column, width: int = 10) -> Column:
    """H17. A text bar of a probability, full and empty cells; rounded half to even."""
    n = F.bround(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) * width, 0).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(width) - n))


def cosine_rate(rate: float, epoch: Column, cycle: int) -> Column:
    """H23. Learning rate of an epoch under restarted cosine decay."""
    return F.lit(rate) * 0.5 * (1 + F.cos(F.pi() * (epoch % cycle) / cycle))


def display_name(c: Column, names: dict[str, str]) -> Column:
    """H24. A name from a table, itself if the table has none."""
    if not names:
        return c
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), c)


def prefixed(text: Column, instruction: str) -> Column:
    """P23. The text after a fixed instruction and an empty line; unchanged if the instruction is blank."""
    return text if not instruction.strip() else F.concat(F.lit(instruction.strip() + "\n\n"), F.trim(text))
