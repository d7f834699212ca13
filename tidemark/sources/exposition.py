"""The text exposition format as column expressions: one row per body in, one row per sample out.

Lines end at CRLF, LF or CR; those that begin with # or are blank are skipped. A line is cut at single blanks: name and labels,
value, optional epoch milliseconds; more parts are ignored. The value follows Java's grammar of doubles. Labels are cut at commas and
equal signs without regard to quotes; entries of exactly two parts stay, quotes around the value go, the last of equal
keys wins, and agent_id is always the scraped agent. A line that doesn't fit is dropped; it never fails its body."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry of exactly two parts: key, value without the quotes around it.
_ENTRY = r'(?:^|,)([^,=]*)="*([^,=]*?)"*(?=,|\z)'


def parse(bodies: DataFrame) -> DataFrame:
    """bodies: agent_id, body (other columns are kept). Returns these without body, and line (its place in the body, from 0), name, value, timestamp (null if the line has none), tags."""
    others = [c for c in bodies.columns if c not in ("body", "line", "name", "value", "timestamp", "tags")]
    # lines are cut inside the generator, so that the filters below read their parts and don't cut them again; a blank line has no value
    lines = F.transform(F.split("body", "\r\n|\n|\r"), lambda x: F.split(x, " ", -1))
    rows = bodies.select(*others, F.posexplode(lines).alias("line", "parts")).where(F.size("parts") >= 2)
    rows = rows.select(*others, "line", F.get("parts", F.lit(0)).alias("head"), F.get("parts", F.lit(1)).alias("value_text"), F.get("parts", F.lit(2)).alias("time_text"))
    rows = rows.where(~F.startswith(F.col("head"), F.lit("#")))
    # the words for infinity and not-a-number count only as Java spells them
    word = F.lower("value_text").rlike("^[+-]?(inf|infinity|nan)[df]?$") & ~F.col("value_text").rlike("^[+-]?(Infinity|NaN)$")
    millis = F.when(F.col("time_text").rlike("^[+-]?[0-9]+$"), F.expr("try_cast(time_text as bigint)"))
    opened = F.instr("head", "{")
    closed = F.when(F.contains(F.col("head"), F.lit("}")), F.length("head") + 1 - F.instr(F.reverse("head"), "}")).otherwise(0)
    rows = rows.where(((opened == 0) | (closed > opened)) & ~word & F.expr("try_cast(value_text as double)").isNotNull() & (F.col("time_text").isNull() | millis.isNotNull()))
    inner = F.when(opened > 0, F.substring(F.col("head"), opened + 1, closed - opened - 1)).otherwise("")
    keys, values = (F.regexp_extract_all(inner, F.lit(_ENTRY), F.lit(k)) for k in (1, 2))
    tags = F.map_from_arrays(F.concat(keys, F.array(F.lit("agent_id"))), F.concat(values, F.array("agent_id")))
    name = F.when(opened > 0, F.substring(F.col("head"), F.lit(1), opened - 1)).otherwise(F.col("head"))
    return rows.select(*others, "line", name.alias("name"), F.col("value_text").cast("double").alias("value"), F.timestamp_millis(millis).alias("timestamp"), tags.alias("tags"))
