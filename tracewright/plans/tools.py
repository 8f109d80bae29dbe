"""Queries of tool calls."""

from pyspark.sql import functions as F

from tracewright.functions import tools
from tracewright.plans.registry import query
from tracewright.sources import fixtures as X

# Each turn says its text and calls one to three tools; every third turn one of the calls is broken.
MARKED = r"""concat(text, '<tool_call>{"name": "open", "arguments": {"turn":', turn, ',"say": "é \\"ok\\"", "at":[1.50,null]}}</tool_call>',
 CASE turn % 3 WHEN 1 THEN '<tool_call>{"name": broken</tool_call> or <tool_call>{"name": 7, "arguments": {}}</tool_call>' WHEN 2 THEN concat(' then <tool_call>\n{"arguments": [', conv_id, ',2], "name": "list"}\n</tool_call>') ELSE '' END,
 ' end <tool_call>{"name": "open"')"""


@query(r"""WITH one AS (SELECT conv_id, turn, 0 AS place, 'open' AS name, '{"turn": ' || turn || ', "say": "é \"ok\"", "at": [1.5, null]}' AS arguments, false AS broken FROM conversations
 UNION ALL SELECT conv_id, turn, 1, 'list', '[' || conv_id || ', 2]', false FROM conversations WHERE turn % 3 = 2
 UNION ALL SELECT conv_id, turn, k, NULL, NULL, true FROM conversations, (VALUES (1), (2)) v(k) WHERE turn % 3 = 1)
 SELECT one.*, md5(text || CASE turn % 3 WHEN 1 THEN ' or ' WHEN 2 THEN ' then ' ELSE '' END || ' end <tool_call>{"name": "open"') AS content FROM one JOIN conversations USING (conv_id, turn)""")
def fn_tool_calls(spark, d):
    """Every call of every turn, broken ones as errors, and what is left of the text."""
    c = X.read(spark, d, "conversations").select("conv_id", "turn", F.expr(MARKED).alias("said"))
    out = tools.tool_calls(c, "said").withColumn("content", F.md5(tools.content(F.col("said")).cast("binary")))
    return out.select("conv_id", "turn", "place", "name", "arguments", F.col("error").isNotNull().alias("broken"), "content")


CHANNELS = r"""concat('<|channel|>analysis<|message|>call <|start|>assistant<|channel|>commentary to=functions.none <|constrain|>json<|message|>{}<|call|><|end|>', role,
 '<|start|>assistant<|channel|>commentary to=functions.look <|constrain|>json<|message|>{"turn":', turn, '}<|call|>', CASE WHEN turn % 2 = 1 THEN '<|start|>assistant<|channel|>commentary to=functions.tell_all <|constrain|>json<|message|>{broken<|call|>' ELSE '' END, '<pad><pad>')"""


@query("""SELECT conv_id, turn, 0 AS place, 'look' AS name, '{"turn":' || turn || '}' AS arguments, role AS content FROM conversations
 UNION ALL SELECT conv_id, turn, 1, 'tell_all', '{broken', role FROM conversations WHERE turn % 2 = 1""")
def fn_tool_calls_channels(spark, d):
    """Calls on channels, as SQL runs them; those within thoughts don't count."""
    tools.register_tool_calls(spark)
    X.read(spark, d, "conversations").select("conv_id", "turn", F.expr(CHANNELS).alias("said")).createOrReplaceTempView("_said")
    out = spark.sql("SELECT conv_id, turn, said, place, name, arguments FROM _said, LATERAL tool_calls(said, 'channels')")
    return out.select("conv_id", "turn", "place", "name", "arguments", tools.content(F.col("said"), "channels", "<pad>").alias("content"))
