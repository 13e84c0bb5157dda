"""Options, schemas and closed vocabularies shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Fixed values ---------------------------------------------------------------------------------
ATTACK_TYPES = [
    "instruction_override", "role_change", "secret_extraction", "tool_abuse", "credential_theft",
    "context_poisoning", "multi_step_jailbreak", "encoded_instructions", "indirect_injection",
]
OUTSIDE_TYPE = "indirect_injection"
JUDGE_TYPES = [t for t in ATTACK_TYPES if t != OUTSIDE_TYPE]
CONFIDENCES = ["low", "medium", "high"]
MAX_CHARS = 20_000
MIN_QUOTE = 8
MAX_WIDEN = 2
MAX_DECODE_DEPTH = 2
WINDOW_UNITS = 3
# End of fixed values --------------------------------------------------------------------------


@dataclass(frozen=True)
class Options:
    """Thresholds and switches of one screening run."""

    threshold: float = 0.65  # a scorer flags at or above this
    language_threshold: float = 0.50  # a line is English at or above this
    min_words: int = 6  # shorter lines are not judged for language on their own
    hidden_strong: bool = False  # treat any signal on concealed text as strong
    always: bool = False  # consult judge and sandbox evidence on clean items too
    secret: str = ""  # mixed into check codes and fences: set one per run that no content can know
    max_reason: int = 500  # characters of a judge's reason that are kept
    lone_scorer: str = "scorer_b"  # the scorer whose lone flag already means medium confidence


SPAN = T.StructType([
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

ITEMS = T.StructType([
    T.StructField("item_id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("user_task", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("hidden", T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ]))),
    T.StructField("llm", T.StringType()),
])

SPAN_ARRAY = "array<struct<start:int,end:int,text:string>>"
UNIT_ARRAY = "array<struct<unit_no:int,start:int,end:int,text:string>>"
LAYER_ARRAY = "array<struct<kind:string,start:int,end:int,text:string,depth:int,hidden:boolean>>"
HIT_ARRAY = "array<struct<rule:string,type:string,strength:string,start:int,end:int,text:string,layer:string>>"
GROUP_ARRAY = "array<struct<units:array<int>,flagged_by:array<string>,scores:map<string,double>>>"
EVIDENCE_ARRAY = (
    "array<struct<start:int,end:int,hits:" + HIT_ARRAY + ",scorers:array<string>,encoded:boolean,hidden:boolean>>"
)
CUT_ARRAY = (
    "array<struct<start:int,end:int,types:array<string>,found_by:array<string>,rules:array<string>,strong_rule:boolean>>"
)
FLAG_ARRAY = "array<struct<unit_no:int,start:int,end:int,text:string,p_eng:double,top:string,by:string>>"


def empty(kind: str):
    """An empty array column of a SQL type, so unions and coalesce keep one schema."""
    from pyspark.sql import functions as F

    return F.array().cast(kind)
