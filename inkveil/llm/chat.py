"""Chat formatting with Spark expressions only.

A conversation's turn structs are collected and sorted, adjacent turns of one role are sliced into one block (an array of turns), and
blocks are concatenated: ``<|im_start|>role\\ntext<|im_end|>\\n``, with ``<|turn|>`` between the texts
of a block. In roles and texts ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|`` (in roles also a line feed
``&nl;``), so that a control string in the output is always the template's own and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, TURN = "<|im_start|>", "<|im_end|>\n", "<|turn|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("&nl;"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted (string), loss (array of struct start, end: code points of `formatted`, end exclusive).

    `loss` covers each text of `loss_role` and nothing of the template. Turns go by turn, then role, then text
    (nulls first); repeated rows are formatted as often as they occur. A null role or text counts as empty; rows of a null conv_id are
    one conversation. An empty table gives no rows. A conversation becomes one string, so it must be below 2 GB.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = turns.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    shown = F.transform("turns", lambda t: F.struct(escaped_role(t["role"]).alias("role"), escaped(t["text"]).alias("text"), (t["role"] == loss_role).alias("loss")))
    chats = chats.select("conv_id", shown.alias("turns"), _where("turns", lambda role, before: role != before).alias("opens"))
    # adjacent turns of one role become one block: the slice from where it opens to where the next one does
    blocks = F.transform("opens", lambda at, k: F.slice("turns", at + 1, F.coalesce(F.get("opens", k + 1), F.size("turns")) - at))
    header = lambda b: F.concat(F.lit(START), F.get(b, 0)["role"], F.lit("\n"))
    text = F.array_join(F.transform(blocks, lambda b: F.concat(header(b), F.array_join(F.transform(b, lambda t: t["text"]), TURN), F.lit(END))), "")
    # characters before each text: a separator inside a block, else the end of the block before and a header
    before = lambda t, i: F.when((i > 0) & (F.get("turns", i - 1)["role"] == t["role"]), len(TURN)).otherwise(F.when(i > 0, len(END)).otherwise(0) + len(START) + F.length(t["role"]) + 1)
    lengths = F.transform("turns", lambda t, i: F.struct(before(t, i).alias("before"), (before(t, i) + F.length(t["text"])).alias("all"), t["loss"].alias("loss")))
    chats = chats.select("conv_id", text.alias("formatted"), lengths.alias("lengths"))
    chats = chats.select("conv_id", "formatted", "lengths", _sums(F.transform("lengths", lambda x: x["all"])).alias("starts"))
    spans = F.transform("lengths", lambda x, i: F.when(x["loss"], F.struct((F.get("starts", i) + x["before"]).alias("start"), (F.get("starts", i) + x["all"]).alias("end"))))
    return chats.select("conv_id", "formatted", F.array_compact(spans).alias("loss"))


def _where(turns: str, differs) -> Column:
    """Places of the turns whose role differs from the one before (the first has none before)."""
    places = F.transform(turns, lambda t, i: F.when((i == 0) | differs(t["role"], F.get(turns, i - 1)["role"]), i))
    return F.array_compact(places)


def _sums(numbers: Column, part: int = 128) -> Column:
    """For each number the sum of those before it. Sums of parts are added first, so that the work does not grow with the square of the length
    (an array that grows in a fold would be copied at every step)."""
    one = F.lit(0)
    total = lambda xs: F.aggregate(xs, one, lambda a, x: a + x)

    def by_part(xs: Column) -> Column:
        count = F.ceil(F.size(xs) / part).cast("int")
        return F.when(F.size(xs) > 0, F.transform(F.sequence(one, count - 1), lambda k: total(F.slice(xs, k * part + 1, F.lit(part))))).otherwise(F.array().cast("array<int>"))

    def before(xs: Column, parts: Column) -> Column:
        heads = F.transform(parts, lambda _, k: total(F.slice(parts, F.lit(1), k)))
        joined = lambda heads: F.transform(xs, lambda _, i: F.get(heads, F.floor(i / part).cast("int")) + total(F.slice(xs, F.floor(i / part).cast("int") * part + 1, i % part)))
        return F.get(F.transform(F.array(heads), joined), 0)

    return F.get(F.transform(F.array(numbers), lambda xs: F.get(F.transform(F.array(by_part(xs)), lambda parts: before(xs, parts)), 0)), 0)


def parsed(formatted_text: Column) -> Column:
    """Array of struct role, text: the turns, read back from a formatted conversation."""
    blocks = F.slice(F.split(formatted_text, r"\Q<|im_end|>\E\n", -1), F.lit(1), F.size(F.split(formatted_text, r"\Q<|im_end|>\E\n", -1)) - 1)
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(_body(b), r"\Q<|turn|>\E", -1),
                lambda t: F.struct(unescaped_role(_role(b)).alias("role"), unescaped(t).alias("text")),
            ),
        )
    )


def _role(block: Column) -> Column:
    return F.substring(F.substring_index(block, "\n", 1), len(START) + 1, 2**31 - 1)


def _body(block: Column) -> Column:
    return F.substring(block, F.length(F.substring_index(block, "\n", 1)) + F.lit(2), F.length(block))


def loss_text(formatted_text: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted_text, s["start"] + 1, s["end"] - s["start"]))), "")


def digest(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: all read back from the output."""
    back = chats.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("learned"))
    listing = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listing, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
