"""Chat formatting: fingerprints of schemas select the mapping to canonical turns.

A layout is known by its nested field paths (``messages[].content``).  The fingerprint of a
frame or of a JSON record is a hash of the paths it has among a layout's own; where it
equals the layout's, the layout's declared mapping gives the turns, an array of (role, text).
Other fields are ignored, so extra columns do no harm; of several fitting layouts the first
in LAYOUTS is taken.

Format of a conversation: ``<s>``, then for each turn ``[INST]role[/INST]text</s>``.  In roles
and texts a backslash is doubled and a control string gets a backslash after its first
character, so it never occurs there; ``read`` undoes both.  The loss mask lists (start, length)
in code points of the assistant texts.

Null roles and texts are empty, a conversation's turns stand by turn, then role, then text
(null first); rows with a null id are one conversation.  One conversation is one row of the output and so
must fit a task, as a text must.  Column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The control strings, and the pattern that finds where to break or mend one.
OPEN, CLOSE, START, END = "[INST]", "[/INST]", "<s>", "</s>"
_CONTROL = r"<(?=/?s>)|\[(?=/?INST\])"
_BROKEN = r"(?<=<)\\(?=/?s>)|(?<=\[)\\(?=/?INST\])"

TURNS = "array<struct<role: string, text: string>>"


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', {role}, 'text', coalesce({text}, ''))"


def _list(column: str, role: str, text: str) -> str:
    spoken = f"CASE lower(x.{role}) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE coalesce(x.{role}, '') END"
    return f"transform(coalesce({column}, array()), x -> {_turn(spoken, f'x.{text}')})"


def _pair(user: str, assistant: str) -> str:
    return f"""array({_turn("'user'", user)}, {_turn("'assistant'", assistant)})"""


def _maybe(role: str, text: str) -> str:
    """A turn that is left out where the text is null or empty."""
    return f"""if(coalesce({text}, '') = '', CAST(array() AS {TURNS}), array({_turn(f"'{role}'", text)}))"""


#: (name, field paths, schema, mapping to turns), most specific first; ``{r}`` is the record.
LAYOUTS = (
    ("messages", ("messages[].role", "messages[].content"), "messages array<struct<role: string, content: string>>",
     _list("{r}messages", "role", "content")),
    ("conversations", ("conversations[].from", "conversations[].value"), "conversations array<struct<`from`: string, value: string>>",
     _list("{r}conversations", "`from`", "value")),
    ("instruction_input", ("instruction", "input", "output"), "instruction string, input string, output string",
     _pair("concat_ws('\\n', {r}instruction, nullif({r}input, ''))", "{r}output")),
    ("instruction", ("instruction", "output"), "instruction string, output string",
     _pair("{r}instruction", "{r}output")),
    ("system_prompt", ("system", "prompt", "response"), "system string, prompt string, response string",
     f"concat({_maybe('system', '{r}system')}, {_pair('{r}prompt', '{r}response')})"),
    ("prompt_response", ("prompt", "response"), "prompt string, response string",
     _pair("{r}prompt", "{r}response")),
    ("prompt_completion", ("prompt", "completion"), "prompt string, completion string",
     _pair("{r}prompt", "{r}completion")),
    ("rows", ("conv_id", "turn", "role", "text"), None, None),
)


def paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths down to the leaves, arrays marked ``[]``."""
    if isinstance(schema, T.StructType):
        dot = "." if prefix else ""
        return [p for f in schema.fields for p in paths(f.dataType, f"{prefix}{dot}{f.name}")]
    if isinstance(schema, T.ArrayType):
        return paths(schema.elementType, prefix + "[]")
    return [prefix]


def _hash(found: Column) -> Column:
    return F.xxhash64(F.array_join(F.array_sort(found), ","))


def layout_of(df: DataFrame) -> str:
    """Name of the first layout whose fingerprint the frame's schema has."""
    found = set(paths(df.schema))
    prints = df.sparkSession.range(1).select(
        *[
            (_hash(F.array(*[F.lit(p) for p in own if p in found]).cast("array<string>")) == _hash(F.array(*map(F.lit, own)))).alias(name)
            for name, own, _, _ in LAYOUTS
        ]
    )
    row = prints.first()
    for name, *_ in LAYOUTS:
        if row[name]:
            return name
    raise ValueError(f"no known conversation layout among {sorted(found)}")


def json_paths(json: Column) -> Column:
    """Field paths of a JSON object: its keys, and the keys of the first element of lists of objects."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))

    def below(name):
        inner = F.json_object_keys(F.get_json_object(json, f"$.{name}[0]"))
        return F.coalesce(F.transform(inner, lambda k: F.concat(F.lit(f"{name}[]."), k)), F.array().cast("array<string>"))

    return F.concat(keys, below("messages"), below("conversations"))


def canonical_json(df: DataFrame, id: str, json: str) -> DataFrame:
    """(id, turns) for JSON records in mixed layouts; each row's fingerprint selects its own
    mapping, and turns are null where no layout fits."""
    found, turns = json_paths(F.col(json)), F.lit(None).cast(TURNS)
    for _, own, schema, mapping in reversed(LAYOUTS):
        if mapping is not None:
            whole = F.array(*map(F.lit, own))
            record = f"transform(array(from_json(`{json}`, '{schema}')), r -> {mapping.format(r='r.')})[0]"
            turns = F.when(_hash(F.array_intersect(found, whole)) == _hash(whole), F.expr(record).cast(TURNS)).otherwise(turns)
    return df.select(id, turns.alias("turns"))


def canonical(df: DataFrame, id: str = "conv_id") -> DataFrame:
    """(id, turns) for a frame in any known layout."""
    name = layout_of(df)
    mapping = {n: m for n, _, _, m in LAYOUTS}[name]
    if mapping is not None:
        return df.select(id, F.expr(mapping.format(r="")).cast(TURNS).alias("turns"))
    spoken = df.select(id, "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return spoken.groupBy(id).agg(F.transform(ordered, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, _CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    mended = F.regexp_replace(text, _BROKEN, "")
    return F.regexp_replace(mended, r"\\\\", r"\\")


def formatted(conversations: DataFrame, id: str = "conv_id") -> DataFrame:
    """(id, formatted, loss) from (id, turns); loss is an array of (start, length)."""
    safe = conversations.select(
        id, F.transform("turns", lambda x: F.struct(escape(x["role"]).alias("role"), escape(x["text"]).alias("text"), (x["role"] == "assistant").alias("learnt"))).alias("turns")
    )
    whole = F.concat(F.lit(START), F.array_join(F.transform("turns", lambda x: F.concat(F.lit(OPEN), x["role"], F.lit(CLOSE), x["text"], F.lit(END))), ""))
    marks = len(OPEN) + len(CLOSE)
    step = F.aggregate(
        "turns",
        F.struct(F.lit(len(START)).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + marks + F.length(x["role"]) + F.length(x["text"]) + len(END)).alias("at"),
            F.when(
                x["learnt"],
                F.concat(a["spans"], F.array(F.struct((a["at"] + marks + F.length(x["role"])).alias("start"), F.length(x["text"]).cast("long").alias("length")))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return safe.select(id, whole.alias("formatted"), step.alias("loss"))


def read(output: DataFrame, id: str = "conv_id") -> DataFrame:
    """(id, turns, learnt, formatted) from (id, formatted, loss) alone."""
    parts = F.split(F.expr(f"substring(formatted, {len(START) + 1})"), END)

    def turn(part):
        role = F.substring_index(part, CLOSE, 1)
        text = F.substr(part, F.length(role) + F.lit(len(CLOSE) + 1))
        return F.struct(unescape(F.substr(role, F.lit(len(OPEN) + 1))).alias("role"), unescape(text).alias("text"))

    turns = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)
    learnt = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return output.select(id, turns.alias("turns"), F.array_join(learnt, "").alias("learnt"), "formatted")


def digest(conversations: DataFrame, id: str = "conv_id") -> DataFrame:
    back = read(formatted(canonical(conversations, id), id), id)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        id,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
