"""Conversation-shaped transcripts derived from the ``conversations`` table.

A user row becomes a prompt (or machine text in a few conversations), an
assistant row becomes a reply with thinking and tool calls followed by its tool
results, and a system row a command or an entry type the model does not know.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.functions.once import computed_once
from threadline.plans.standins import spread, table


def _t(s: str) -> Column:
    return F.lit(s).cast("string")


def talk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, line_no, raw``; row ``turn`` of a conversation fills lines ``4 turn`` and ``4 turn + 1``."""
    c, t, text = F.col("conv_id"), F.col("turn"), F.col("text")
    rows = spread(table(spark, sf_dir, "conversations"), "conv_id", "turn").withColumn(
        "stamp",
        F.when(
            ~((t == 3) & (c % 5 == 0)),
            F.date_format(F.timestamp_seconds(F.lit(1704067200) + c * 1000 + t * 97), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        ),
    )
    odd = t == 2
    prompt = (
        F.when(odd & (c % 10 == 4), _t("<task-notification> done </task-notification>"))
        .when(odd & (c % 10 == 5), F.concat(_t("Stop hook feedback: "), text))
        .when(t % 4 == 2, F.concat(text, _t(" <system-reminder> be brief </system-reminder>")))
        .otherwise(text)
    )
    head = [
        F.col("stamp").alias("timestamp"), F.concat(_t("conv-"), c).alias("sessionId"), _t("/home/ann/work/talk").alias("cwd"),
        F.when(c % 4 == 1, F.concat(_t("slug "), c)).alias("slug"),
    ]
    user = F.to_json(
        F.struct(
            _t("user").alias("type"), *head, F.when(odd & (c % 10 == 3), F.lit(True)).alias("isMeta"),
            F.struct(_t("user").alias("role"), prompt.alias("content")).alias("message"),
        )
    )
    inp = lambda **kw: F.struct(*[kw.get(k, F.lit(None).cast("string")).alias(k) for k in ("command", "file_path")])
    no_input = F.lit(None).cast("struct<command:string,file_path:string>")
    block = lambda kind, said=None, thought=None, name=None, given=no_input: F.struct(
        _t(kind).alias("type"), (F.lit(None).cast("string") if said is None else said).alias("text"),
        (F.lit(None).cast("string") if thought is None else thought).alias("thinking"),
        (F.lit(None).cast("string") if name is None else _t(name)).alias("name"), given.alias("input"),
    )
    thought = F.when(c % 3 == 0, _t(" ")).otherwise(F.concat(_t("# "), F.substring(text, 1, 90)))
    blocks = F.concat(
        F.array(block("thinking", thought=thought), block("text", said=text), block("tool_use", name="Bash", given=inp(command=F.concat(_t("ls "), t)))),
        F.when(t % 4 == 1, F.array(block("tool_use", name="Write", given=inp(file_path=F.concat(_t("/f"), c % 5, _t(".py"))))))
        .otherwise(F.array(block("tool_use", name="Edit", given=inp(file_path=F.concat(_t("/f"), t, _t(".py")))))),
        F.when(c % 7 == 0, F.array(block("odd"))).otherwise(F.array().cast("array<struct<type:string,text:string,thinking:string,name:string,input:struct<command:string,file_path:string>>>")),
    )
    reply = F.to_json(
        F.struct(
            _t("assistant").alias("type"), *head,
            F.struct(_t("assistant").alias("role"), _t("claude-opus-4-8").alias("model"), blocks.alias("content")).alias("message"),
        )
    )
    out = (
        F.when(c % 6 == 0, F.concat(_t("Error: bad "), text))
        # Some sessions push what they commit, in the results of the same calls.
        .when(
            c % 6 == 1,
            F.concat(
                _t("[main abc1234] fix "), t, _t("\n[dev deadbeef0] more\n"),
                F.when(c % 12 == 1, F.concat(_t("remote: https://github.com/ann/app"), c % 3, _t("/pull/new/x\n"))).otherwise(""), text,
            ),
        )
        .when(c % 6 == 2, F.concat(_t("remote: https://github.com/ann/app"), c % 3, _t("/pull/new/x\n"), text))
        .otherwise(text)
    )
    result = F.to_json(
        F.struct(
            _t("user").alias("type"), *head,
            F.struct(_t("user").alias("role"), F.array(F.struct(_t("tool_result").alias("type"), out.alias("content"))).alias("content")).alias("message"),
            F.when(
                (c % 8).isin(1, 3),
                F.struct(
                    F.concat(_t("out "), t).alias("stdout"), F.when(c % 8 == 3, _t("warn")).alias("stderr"),
                    F.when(c % 8 == 3, F.lit(True)).alias("interrupted"), _t("x").alias("other"),
                ),
            ).alias("toolUseResult"),
        )
    )
    system = F.to_json(
        F.struct(
            F.when(c % 2 == 0, _t("system")).otherwise(_t("mystery")).alias("type"), *head,
            _t("local_command").alias("subtype"), text.alias("content"),
        )
    )
    role = F.col("role")
    raws = F.when(role == "user", F.array(user)).when(role == "assistant", F.array(reply, result)).otherwise(F.array(system))
    made = computed_once(rows, {"raws": raws}).select(
        F.concat(_t("/talk/conv-"), c, _t(".jsonl")).alias("path"), "turn", F.posexplode("raws").alias("j", "raw")
    )
    return made.select("path", (F.col("turn") * 4 + F.col("j")).alias("line_no"), "raw")
