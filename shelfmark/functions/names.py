"""Deterministic name normaliser: Title_Snake_Case with fixed clean-ups.

The steps run in a fixed order over the name without its extension: camel case,
semester codes and year ranges, separators, phrases, clutter, numbers,
abbreviations, acronyms, title case, repeats. The extension is never changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import paths

# Word lists of the naming rules.
ACRONYMS = ["OS", "DSA", "TCP", "AI", "DBMS", "LAB", "ID", "API", "JSON"]
GENERIC_PREFIXES = [
    "department",
    "university",
    "institute",
    "college",
    "school",
    "faculty",
    "part",
    "chapter",
    "section",
    "introduction",
]
CLUTTER = ["copy", "final", "draft", "new", "document", "file", "download", "backup"]
ABBREVIATIONS = {
    "assignment": "Asn",
    "experiment": "Exp",
    "laboratory": "Lab",
    "semester": "S",
    "sem": "S",
    "project": "Proj",
    "syllabus": "Syl",
    "introduction": "Intro",
}
LONG_NAME_TOKENS = 6
LONG_NUMBER_DIGITS = 6

# Stands for the hyphen of a semester code while hyphens become separators.
_KEPT_HYPHEN = ""
_DATE = "^(19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])$"


def _semesters(text: Column) -> Column:
    for season, letter in (("fall", "F"), ("winter", "W")):
        text = F.regexp_replace(
            text,
            rf"(?i)(^|[_ .-]){season}[_ ]?s(?:em)?[_ ]?(?:20)?([0-9]{{2}})-(?:20)?([0-9]{{2}})",
            rf"$1{letter}$2{_KEPT_HYPHEN}$3",
        )
    return F.regexp_replace(text, r"(?i)(^|[_ .-])sem(?:ester)?[_ .-]*0*([0-9]+)", "$1S$2")


def _separated(stem: Column) -> Column:
    text = F.regexp_replace(stem, r"(\p{Ll})(\p{Lu})", "$1_$2")
    text = F.regexp_replace(text, r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1_$2")
    text = F.regexp_replace(text, r"(?i)[(]([0-9]+|copy)[)]", "")
    text = _semesters(text)
    text = F.regexp_replace(
        text, r"(^|[^0-9])((?:19|20)[0-9]{2})-(?:19|20)([0-9]{2})($|[^0-9])", "$1$2_$3$4"
    )
    text = F.regexp_replace(text, r"[ \t\n._-]+", "_")
    text = F.regexp_replace(text, r"(?i)(^|_)copy_of(_|$)", "_")
    text = F.regexp_replace(text, r"(?i)^_?microsoft_word(_|$)", "_")
    return F.regexp_replace(text, r"(?i)(^|_)question_paper(_|$)", "$1QP$2")


def _token(token: Column) -> Column:
    settled = f"^([FW][0-9]{{2}}{_KEPT_HYPHEN}[0-9]{{2}}|S[0-9]+|QP|v[0-9]+)$"
    forms = {a.lower(): a for a in ACRONYMS} | ABBREVIATIONS
    form = F.create_map(*[F.lit(x) for pair in forms.items() for x in pair])
    title = F.concat(F.upper(F.substring(token, 1, 1)), F.lower(F.substr(token, F.lit(2))))
    return F.when(token.rlike(settled), token).otherwise(F.coalesce(form[F.lower(token)], title))


def with_normalized_name(df: DataFrame, name: str, out: str = "new_name") -> DataFrame:
    """Add the normalised base name; a name of clutter only stays as it is.

    Each step is a column of its own, so that no step is evaluated twice.
    """
    long_number = rf"^[0-9]{{{LONG_NUMBER_DIGITS},}}$"

    def kept(token: Column) -> Column:
        number = token.rlike(long_number) & ~token.rlike(_DATE)
        return ~F.lower(token).isin(CLUTTER) & ~number

    def is_specific(token: Column) -> Column:
        return ~F.lower(token).isin(GENERIC_PREFIXES)

    tokens = F.filter(F.split("_separated", "_", -1), lambda t: t != "")
    # Long names lose generic words in front of the first specific one.
    first = F.array_position(F.transform("_tokens", is_specific), True).cast("int")
    is_long = (F.size("_tokens") > LONG_NAME_TOKENS) & (F.col("_first") > 1)
    # Slicing starts at 1 or later even where it is not used.
    shortened = F.slice("_tokens", F.greatest("_first", F.lit(1)), F.greatest(F.size("_tokens"), F.lit(1)))
    words = F.array_distinct(F.transform(F.filter("_tokens", kept), _token))
    joined = F.replace(F.array_join(words, "_"), F.lit(_KEPT_HYPHEN), F.lit("-"))
    return (
        df.withColumn("_separated", _separated(paths.stem(name)))
        .withColumn("_tokens", tokens)
        .withColumn("_first", first)
        .withColumn("_tokens", F.when(is_long, shortened).otherwise(F.col("_tokens")))
        .withColumn("_joined", joined)
        .withColumn(
            out,
            F.when(F.col("_joined") == "", F.col(name)).otherwise(
                F.concat("_joined", paths.extension(name))
            ),
        )
        .drop("_separated", "_tokens", "_first", "_joined")
    )
