"""Chat formatting as relational algebra: sort turn structs, merge same-role neighbours, concatenate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Control strings of the template. All begin with "<|", which escaping keeps out of roles and texts.
TURN, SAYS, JOIN, END = "<|turn|>", "<|says|>", "<|join|>", "<|end|>"


def escaped(text: str) -> str:
    """SQL: one backslash more between every "<" and the "|" behind it, so no control string is left; reversible."""
    return rf"regexp_replace({text}, r'<(\\*)\|', r'<$1\\|')"


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: its id, `formatted`, and `mask`, runs (n code points, loss or not) that cover it.

    Turns are sorted by (turn, role, text), nulls first; null roles and texts count as empty, so ties and repeated
    rows have one order. Neighbours of one role share a block, in which their texts are joined by a control string;
    the loss mask covers the texts of loss_role and no control string. A null id is one conversation; other
    columns are ignored; an empty table gives none. A conversation is one row by nature, nothing else is gathered.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sort = F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))))
    got = turns.groupBy(F.col(conv_col).alias("_conv")).agg(sort.alias("_t"))
    got = got.withColumn("_starts", F.expr("filter(sequence(0, size(_t) - 1), i -> i = 0 OR _t[i].role <> _t[i - 1].role)"))
    got = got.withColumn("_blocks", F.expr(f"""transform(_starts, (s, k) -> named_struct('role', _t[s].role, 'texts',
        transform(slice(_t, s + 1, coalesce(get(_starts, k + 1), size(_t)) - s), t -> {escaped('t.text')})))"""))
    got = got.withColumn("formatted", F.expr(f"""array_join(transform(_blocks, b ->
        concat('{TURN}', {escaped('b.role')}, '{SAYS}', array_join(b.texts, '{JOIN}'), '{END}')), '')"""))
    header = f"{len(TURN) + len(SAYS)} + length({escaped('b.role')})"
    got = got.withColumn("mask", F.expr(f"""flatten(transform(_blocks, b -> flatten(transform(b.texts, (x, i) -> array(
        named_struct('n', IF(i = 0, {header}, {len(JOIN)}), 'loss', false),
        named_struct('n', length(x), 'loss', b.role = '{loss_role}'),
        named_struct('n', IF(i = size(b.texts) - 1, {len(END)}, 0), 'loss', false))))))"""))
    return got.select(F.col("_conv").alias(conv_col), "formatted", "mask")


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _raw(text: Column) -> Column:
    """array<struct<role, texts>> of a formatted string's blocks, still escaped."""
    cut = lambda c, control: F.split(c, control.replace("|", r"\|"), -1)
    blocks = F.transform(F.filter(cut(text, END), lambda b: b != ""), lambda b: cut(F.substr(b, F.lit(len(TURN) + 1)), SAYS))
    return F.transform(blocks, lambda b: F.struct(b[0].alias("role"), cut(b[1], JOIN).alias("texts")))


def parsed(text: Column | str) -> Column:
    """array<struct<role, text>> of the turns that a formatted string holds, each as it was before formatting; null for null."""
    turns = lambda b: F.transform(b["texts"], lambda x: F.struct(unescaped(b["role"]).alias("role"), unescaped(x).alias("text")))
    return F.flatten(F.transform(_raw(_column(text)), turns))


def loss_texts(text: Column | str = "formatted", mask: Column | str = "mask") -> Column:
    """The strings under the loss runs of a formatted string, unescaped, in order.

    The string is cut at its control strings, and the mask, whose every second of three runs is a text, tells which
    pieces count; a run of another length than its piece is an error. Either is walked once, whatever the turns.
    """
    pieces = F.flatten(F.transform(_raw(_column(text)), lambda b: b["texts"]))
    runs = F.filter(_column(mask), lambda r, i: i % 3 == 1)
    both = F.zip_with(pieces, runs, lambda x, r: F.struct(x.alias("x"), r["n"].alias("n"), r["loss"].alias("loss")))
    fits = lambda p: F.when(F.length(p["x"]).eqNullSafe(p["n"]), unescaped(p["x"])).otherwise(F.raise_error(F.lit("the mask does not fit the text")))
    return F.transform(F.filter(both, lambda p: F.coalesce(p["loss"], F.lit(True))), fits)
