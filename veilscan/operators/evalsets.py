"""Building labelled sets: selection, capping, splitting, planting, hiding.

Ranked picks use exact bucketed row numbers (skew.py), so one team, set or category holding a third of
the rows is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions.spans import fence, strip
from veilscan.operators.similar_sets import near_earlier, written
from veilscan.operators.skew import arithmetic_shuffle, first_per_group, number_rows

# Fixed values ---------------------------------------------------------------------------------
CONSTANT_TYPES = ["indirect_injection", "tool_abuse"]
RENAMED = {"indirect_prompt_injection": "indirect_injection"}
FAMILY_TYPES = {
    "direct_instruction_override": "instruction_override", "roleplay_jailbreak": "role_change",
    "multi_agent_trust_spoofing": "role_change", "system_prompt_extraction": "secret_extraction",
    "sensitive_data_exfiltration": "secret_extraction", "tool_action_abuse": "tool_abuse",
    "approval_workflow_bypass": "tool_abuse", "authority_claim_bypass": "context_poisoning",
    "rag_context_poisoning": "context_poisoning", "memory_context_poisoning": "context_poisoning",
    "obfuscation_encoding": "encoded_instructions", "indirect_content_injection": "indirect_injection",
}
HTML_TECHNIQUES = ["comment", "display_none", "aria_hidden", "alt", "white_text", "offscreen"]
PROBE_CHARS = 60
BENIGN = 1000
# End of fixed values --------------------------------------------------------------------------


def email_text(subject: Column, body: Column) -> Column:
    head = strip(subject)
    return F.when(head != "", F.concat(F.lit("Subject: "), head, F.lit("\n\n"), strip(body))).otherwise(strip(body))


def benign_sample(docs: DataFrame, most: int = BENIGN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rn, part): the first ``most`` distinct texts of 20 to 20,000 characters in a fixed shuffle are benign; the others of
    40 to 400 words are carriers. Copies are grouped by a digest, so texts are not shuffled."""
    slim = docs.filter(F.char_length(text).between(20, 20000)).select(
        key, F.sha2(text, 256).alias("_sha"), F.size(F.split(strip(F.col(text)), r"\s+")).alias("words"))
    one = slim.groupBy("_sha").agg(F.min(key).alias(key), F.first("words").alias("words")).drop("_sha")
    ranked = number_rows(one.withColumn("shuffle", arithmetic_shuffle(key)), [], "shuffle", [key])
    part = F.when(F.col("rn") <= most, "benign").otherwise("carrier")
    return ranked.filter((F.col("rn") <= most) | F.col("words").between(40, 400)).select(key, "rn", part.alias("part"))


def working_attacks(raw: DataFrame, labelled: DataFrame, phases: list[str]) -> DataFrame:
    """Rows of the wanted phases that met both objectives, not labelled already, first per (subject, body)."""
    def met(name: str) -> Column:
        return F.coalesce(F.get_json_object("objectives", f"$['{name}']") == "true", F.lit(False))
    kept = raw.filter(F.substring("scenario", -1, 1).isin(phases) & met("exfil.sent") & met("exfil.destination"))
    fresh = kept.join(labelled.select("subject", "body").distinct(), ["subject", "body"], "left_anti")
    return first_per_group(fresh, ["subject", "body"], ["row_id"])


def cap_per_group(df: DataFrame, group: str, k: int, order: str, ties: list[str]) -> DataFrame:
    """At most k rows per group in shuffled order."""
    return number_rows(df, [group], order, ties).filter(F.col("rn") <= k)


def half_per_category(df: DataFrame, category: str, order: str, ties: list[str]) -> DataFrame:
    """The first floor(n / 2) rows of each category in shuffled order."""
    sizes = df.groupBy(category).agg(F.floor(F.count("*") / 2).alias("_half"))
    return number_rows(df, [category], order, ties).join(sizes, category).filter(F.col("rn") <= F.col("_half")).drop("_half")


def disjoint_dev_split(pool: DataFrame, held: DataFrame, key: str, group: str) -> DataFrame:
    """Pool rows whose id and whose group are both absent from the held-out set."""
    return pool.join(held.select(key).distinct(), key, "left_anti").join(held.select(group).distinct(), group, "left_anti")


def round_robin(df: DataFrame, family: str, n: int, order: str, ties: list[str]) -> DataFrame:
    """n rows taken one per family in turn; a top-k over (turn, family)."""
    return number_rows(df, [family], order, ties).orderBy("rn", family).limit(n)


def hide_in_html(text: Column, technique: Column) -> Column:
    """A text wrapped in one hiding technique."""
    safe = F.replace(F.replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")),
                               F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    wrap = {"comment": ("<!-- ", text, " -->"), "display_none": ('<div style="display:none">', safe, "</div>"),
            "aria_hidden": ('<span aria-hidden="true" hidden>', safe, "</span>"), "alt": ('<img src="figure.png" alt="', safe, '">'),
            "white_text": ('<p style="color:#ffffff">', safe, "</p>"), "offscreen": ('<div style="position:absolute; left:-9999px">', safe, "</div>")}
    out = F.lit(None).cast("string")
    for name, (a, body, b) in wrap.items():
        out = F.when(technique == name, F.concat(F.lit(a), body, F.lit(b))).otherwise(out)
    return out


def flat(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def probe(text: Column) -> Column:
    """The first sixty characters with single spaces: what must be gone after cleaning."""
    return F.substring(flat(text), 1, PROBE_CHARS)


def payload_gone(mark: Column, clean: Column, verdict: Column) -> Column:
    return (verdict != "allow") & ~F.contains(F.lower(flat(clean)), F.lower(flat(mark)))


def near_duplicates(rows: DataFrame, team: str, key: str, words: str, threshold: float = 0.6) -> DataFrame:
    """Rows whose word set is at least ``threshold`` similar (Jaccard) to an earlier row of the same team; ``key`` is a long.

    Equal word sets (by 128 bits) are collapsed first, so a group of copies costs one row. The rest are compared in blocks by
    size and parity bits and verified on their words (``similar_sets``): no pair is missed, and no pair is a row that need not be.
    """
    rows = written(rows.select(team, key, fence(F.array_sort(F.array_distinct(words))).alias("_set")).dropna()
                   .withColumns({"_s1": F.xxhash64("_set"), "_s2": F.xxhash64(F.lit(1), "_set")}), "word-sets")
    signs = rows.drop("_set")
    named = written(signs.join(signs.groupBy(team, "_s1", "_s2").agg(F.min(key).alias("_first")), [team, "_s1", "_s2"]).select(team, key, "_first"), "set-copies")
    firsts = named.where(F.col(key) == F.col("_first")).select(team, key).distinct()
    close = near_earlier(rows.join(firsts, [team, key], "left_semi"), team, key, threshold)
    copies = named.where(F.col(key) != F.col("_first")).select(team, key)
    # every copy of a near-duplicate set goes with its first row
    return copies.unionByName(named.join(close.withColumnRenamed("y", "_first"), [team, "_first"], "left_semi").select(team, key)).distinct()
