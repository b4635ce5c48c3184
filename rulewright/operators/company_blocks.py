"""Who made, packed, imported or marketed a package: a role's label, and the company and address in the lines that follow.

Lines are (image_id, line_id, text). Only lines with text count, and a block has ten at most, so a window
over the next ten lines gives all that a block may hold; a fold over them, in order, keeps what belongs to it
and closes it at another declaration or another role.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 10
# Labels of roles, of which the first word names the role, and those that end a block of another.
ROLE = r"\b(?:manufactured|packed|imported|marketed)(?:\s*(?:&|and)\s*packed)?\s+by\b|\b(?:mfg|mfd|mktd|pkg)\.?\s*by\b"
ROLES = {"MANUFACTURER": ("manufactured", "mfg", "mfd"), "PACKER": ("packed", "pkg"), "IMPORTER": ("imported",), "MARKETER": ("marketed", "mktd")}
MAKER, SELLER = r"\b(?:mfg|mfd|manufactured)\.?\s*by\b", r"\b(?:mktd|marketed)\.?\s*by\b"
ENDED_BY = {"MARKETER": MAKER, "MANUFACTURER": SELLER, "PACKER": SELLER}
# Other declarations, words of companies, codes and states.
DECLARATION = r"\b(?:m\.?r\.?p\.?|net\s*qty|mfg\.?\s*date|batch|exp\.?\s*date|best\s*before)\b"
COMPANY = r"\b(?:pvt\.?\s*ltd\.?|private\s+limited|ltd\.?|limited|inc\.?|llp|corp\.?|industries|laboratories|pharmaceuticals|wellness|products)\b"
# A number of a plot or survey is no code, however many digits it has.
NO_PLOT = r"(?<!\b(?:plot|survey|gat|khasra)\s{0,2}(?:no)?[\s.:#-]{0,3})"
PIN = rf"(?i){NO_PLOT}\b(?:pin(?:\s*code)?\s*[:\-–=]*\s*)?([1-9][0-9]{{5}})\b"
STATES = "Maharashtra,Tamil Nadu,Karnataka,Gujarat,Delhi,Uttar Pradesh,Haryana,Punjab,West Bengal,Telangana,Andhra Pradesh,Kerala,Rajasthan,Madhya Pradesh,Bihar,Odisha,Assam,Goa,Uttarakhand,Himachal Pradesh,Jharkhand,Chhattisgarh"
STATE = rf"\b(?:{STATES.replace(' ', chr(92) + 's*').replace(',', '|')})\b"
EDGES, INLINE_EDGES = " |;,.", " :–-=|"


def _has(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


def _before(text: Column, pattern: str, edges: str) -> Column:
    """What stands before the first match of a pattern; all of the text if there is none."""
    return F.trim(F.get(F.split(text, "(?i)" + pattern, 2), F.lit(0)), F.lit(edges))


def role_of(label: Column) -> Column:
    word = F.lower(F.regexp_extract(label, "^[A-Za-z]+", 0))
    out = F.lit(None).cast("string")
    for role, words in ROLES.items():
        out = F.when(word.isin(*words), role).otherwise(out)
    return out


def block(role: Column, inline: Column, following: Column) -> Column:
    """The lines of a role's block, `inline` being what follows the label in its own line: those that follow, until another declaration, another role (what stands before it belongs to the block), or ten."""
    other = F.lit(None).cast("string")
    for name, pattern in ENDED_BY.items():
        other = F.when(role == name, "(?i)" + pattern).otherwise(other)
    cut = lambda text, edges: F.when(other.isNotNull() & F.coalesce(F.regexp_like(text, other), F.lit(False)), F.trim(F.substring(text, F.lit(1), F.regexp_instr(text, other) - 1), F.lit(edges)))
    own = F.coalesce(cut(inline, INLINE_EDGES + ";,."), inline)
    first = F.when((F.length(own) > 1) & ~own.rlike(r"^[a-zA-Z]\s*\|?$"), F.array(own)).otherwise(F.array().cast("array<string>"))

    def step(state: Column, line: Column) -> Column:
        part = cut(line, EDGES)
        more = F.when(part.isNull(), F.array(line)).when(F.length(part) > 2, F.array(part)).otherwise(F.array().cast("array<string>"))
        ends = _has(line, DECLARATION)
        take = state["open"] & ~ends & (F.size(state["kept"]) < MOST)
        return F.struct((take & part.isNull()).alias("open"), F.when(take, F.concat(state["kept"], more)).otherwise(state["kept"]).alias("kept"))

    return F.aggregate(following, F.struct(F.lit(True).alias("open"), first.alias("kept")), step, lambda s: s["kept"])


def company_blocks(lines: DataFrame, image: str = "image_id", order: str = "line_id", code: str = PIN) -> DataFrame:
    """One row for each line with a role's label: role, label, company, address (array), pin_code, state and confidence.

    The company is the first line with a company's word or of six characters, else the first; the rest is the address. A
    label without lines has no company and a confidence of 0. Null and blank texts are left out. The code is the first that
    `code` finds as its first group.
    """
    clean = lines.select(image, order, F.col("text").cast("string").alias("raw"), F.trim(F.col("text").cast("string"), F.lit(EDGES)).alias("text")).where("text != ''")
    following = F.collect_list("text").over(Window.partitionBy(image).orderBy(order).rowsBetween(1, MOST))
    labelled = clean.withColumn("following", following).where(_has(F.col("raw"), ROLE))
    label = F.regexp_substr("raw", F.lit("(?i)" + ROLE))
    inline = F.trim(F.get(F.split(F.trim("raw"), "(?i)" + ROLE, 2), F.lit(1)), F.lit(INLINE_EDGES))
    found = labelled.select(image, order, label.alias("label"), role_of(label).alias("role"), inline.alias("inline"), "following")
    found = found.select(image, order, "role", "label", block(F.col("role"), F.col("inline"), F.col("following")).alias("lines"))
    named = lambda x: _has(x, COMPANY) | (F.length(x) >= 6)
    # the number of the first line that names a company, else of the first
    at = F.coalesce(F.array_min(F.filter(F.transform("lines", lambda x, i: F.when(named(x), i)), lambda i: i.isNotNull())), F.lit(0))
    found = found.withColumn("at", at)
    company = F.get("lines", F.col("at"))
    first = lambda pattern, group: F.get(F.filter(F.transform("lines", lambda x: F.regexp_extract(x, pattern, group)), lambda x: x != ""), F.lit(0))
    return found.select(
        image,
        order,
        "role",
        "label",
        company.alias("company"),
        F.concat(F.slice("lines", F.lit(1), F.col("at")), F.slice("lines", F.col("at") + 2, F.greatest(F.size("lines"), F.lit(1)))).alias("address"),
        first(code, 1).alias("pin_code"),
        first("(?i)" + STATE, 0).alias("state"),
        F.when(company.isNull(), 0.0).when(_has(company, COMPANY), 0.95).otherwise(0.90).alias("confidence"),
    )
