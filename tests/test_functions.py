"""Golden values of the column functions."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import classify, commands, environment, formatting, jsonx, lexical, lint, markdown, rounding, spaces, tokens, validation


def value(spark, column, **literals):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in literals.items())) if literals else spark.range(1)
    return df.select(column.alias("x")).first()[0]


def each(spark, f, inputs, kind="string"):
    """f over rows in order, in one job."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_roundings(spark):
    assert each(spark, rounding.half_up, [-2.5, 2.5, 0.5, 1.4], "double") == [-2, 3, 1, 1]
    assert each(spark, rounding.half_even, [2.5, 3.5, -2.5], "double") == [2.0, 4.0, -2.0]
    assert each(spark, rounding.falsy_zero, [None, float("nan"), 7.0], "double") == [0, 0, 7]


def test_numbers_for_people(spark):
    assert each(spark, formatting.humanize, [0, -3, 999, 1500, 1_250_000, None], "bigint") == ["0", "0", "999", "1.5k", "1.3M", "0"]
    assert each(spark, formatting.usd, [1234.5, 0.05, 0.0028], "double") == ["$1234.50", "$0.050", "$0.0028"]
    assert each(spark, formatting.signed_percent, [0.125, -0.2, 0.0], "double") == ["+12%", "−20%", "+0%"]
    assert each(spark, lambda c: formatting.badge(c, "terse"), ["full", "", "ultra", None, "ul\x1btra"]) == ["[TERSE]", "[TERSE]", "[TERSE:ULTRA]", "[TERSE]", "[TERSE:ULTRA]"]
    assert each(spark, formatting.tail_of_path, ["a" * 50, "b", None]) == ["..." + "a" * 45, "b", ""]
    assert each(spark, lambda c: formatting.without_controls(c, 4), ["a\x00b\x1fcdef"]) == ["abcd"]


MARKDOWN = "# One\n\ntext `a` and `b`\n```sh\n# inside `no`\n```\n## Two\n- x\n* y\n  + z\n~~~\nq `w`\n~~~\nsee https://a.b/c). and ./d/e.py or and/or `a`"


def test_markdown_structure(spark):
    got = each(spark, markdown.headings, [MARKDOWN, None], "string")
    assert [(h["level"], h["title"]) for h in got[0]] == [("#", "One"), ("#", "inside `no`"), ("##", "Two")] and got[1] is None
    assert each(spark, markdown.inline_codes, [MARKDOWN]) == [["a", "b", "a"]]
    assert each(spark, markdown.urls, [MARKDOWN]) == [["https://a.b/c"]]
    assert set(each(spark, markdown.paths, [MARKDOWN])[0]) >= {"./d/e.py", "and/or"}
    assert each(spark, markdown.bullets, [MARKDOWN]) == [3]
    assert each(spark, markdown.words, ["a  b\nc ", ""]) == [3, 0]


@pytest.mark.parametrize(
    ("text", "blocks"),
    [
        ("a\n```py\nx\n```\nb", ["```py\nx\n```"]),
        ("````\n```\ninner\n```\n````", ["````\n```\ninner\n```\n````"]),
        ("~~~\n```\n~~~\n```\nopen", ["~~~\n```\n~~~"]),
        ("   ```\nx\n   ```", ["   ```\nx\n   ```"]),
        ("    ```\nx\n    ```", []),
        ("```\nx\n``` no", []),
        ("", []),
        (None, None),
    ],
)
def test_fenced_blocks(text, blocks):
    assert markdown.fenced_blocks(text) == blocks


def test_fenced_blocks_as_an_expression(spark):
    """The same blocks as the plain version's; no Python in the plan."""
    rng = random.Random(11)
    fence = ["```", "````", "~~~", "~~~~", "`````", "``", "~~", "`~`"]
    line = lambda: rng.choice(["", " ", "   ", "    ", "\t", "\f"]) + rng.choice([*fence, "x", ""]) + rng.choice(["", "", "", " ", "py", " x", "\r", "\x1c", "\x85", "\u3000", "\u200b", "`", "\u2028y"])
    texts = ["\n".join(line() for _ in range(rng.randint(0, 12))) + rng.choice(["", "\n"]) for _ in range(4000)] + [None, "", "```\n" + "x\n" * 100_000 + "```"]
    assert sum(len(markdown.fenced_blocks(t) or []) for t in texts) > 1000
    assert each(spark, markdown.code_blocks, texts) == [markdown.fenced_blocks(t) for t in texts]
    assert "Python" not in spark.range(1).select(markdown.code_blocks(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()


def test_texts_of_a_small_file_are_many_tasks(spark, tmp_path):
    from lexloom.plans import adapters

    spark.createDataFrame([(i, f"n{i}", "b", "t", i % 9, 1.0) for i in range(2000)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    pairs = adapters.markdown_pairs(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(pairs) >= 4 and sum(r["count"] for r in pairs) == 2000 and max(r["count"] for r in pairs) < 1000


def test_front_matter(spark):
    text = "---\nname: x\ntools:\n  - a\n\t- b\nlast: 1\n---\nbody\n---\n"
    front, body = value(spark, markdown.front_matter(F.col("t")), t=text)
    assert front + body == text and body == "body\n---\n"
    assert value(spark, markdown.without_key(F.col("t"), "tools"), t=front) == "---\nname: x\nlast: 1\n---\n"
    assert value(spark, markdown.front_matter(F.col("t")), t="no front") == ("", "no front")
    assert markdown.description("---\nname: a\ndescription: >\n  one\n  two\nother: x\n---") == "one two"
    assert markdown.description("---\ndescription: 'q'\n---") == "q" and markdown.description("x") is None


def test_markers_are_idempotent(spark):
    once = value(spark, markdown.with_block(F.col("t"), "<b>", "<e>", "rules"), t="head\n")
    assert once == "head\n\n<b>\nrules\n<e>\n"
    assert value(spark, markdown.with_block(F.col("t"), "<b>", "<e>", "rules"), t=once) == once
    assert value(spark, markdown.without_block(F.col("t"), "<b>", "<e>"), t=once) == "head\n"
    assert value(spark, markdown.without_block(F.col("t"), "<b>", "<e>"), t="<b>\nx\n<e>\n") is None
    assert value(spark, markdown.between(F.col("t"), "<b>", "<e>", F.lit("new")), t="nothing") is None


CASES = [
    "The clerk holds the key of an office",
    "Certainly, it really only simply reads a row",
    "I'll maybe open the ledger",
    "Call it so: ```\na just sure row;\n``` and then the next",
    "Type `a really simply row` to begin",
    "More is at https://ledger.example/a/simply/page",
    "Open just the sheet under /srv/the/really/sheet.csv",
    "Put the ROW_LIMIT_MAX into the really sheet.rows.limit()",
    "",
    None,
    "théâtre the été",
]


def test_lexical_compressor(spark):
    got = each(spark, lexical.compressed, CASES)
    assert got[0] == "clerk holds key of office"
    assert got[1] == "it only reads row" and got[2] == "open ledger"
    assert "```\na just sure row;\n```" in got[3] and got[3].endswith("and then next") and "`a really simply row`" in got[4]
    assert "https://ledger.example/a/simply/page" in got[5] and got[6] == "Open sheet under /srv/the/really/sheet.csv"
    assert got[7] == "Put ROW_LIMIT_MAX into sheet.rows.limit()"
    assert got[8] == "" and got[9] is None and got[10] == "théâtre été"
    described = "Lists the open orders of a customer. Please make sure to name the customer, and perhaps the year of an order."
    r = value(spark, lexical.report(F.col("t")), t=described)
    assert (r["before"] - r["after"]) / r["before"] > 0.15 and "open orders" in r["compressed"] and "year of order" in r["compressed"]
    assert each(spark, lexical.rephrased, ["In order to run, make sure to test. However, stop"]) == ["to run, ensure test. stop"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["the", "`the a`", "https://x.y/the", "word", "A_B_C", "just,", "/the/a", "\n"]), max_size=12))
def test_protected_spans_survive(spark, parts):
    text = " ".join(parts)
    got = value(spark, lexical.compressed(F.col("t")), t=text)
    for p in parts:
        if p[0] in "`h/A":
            assert got.count(p) >= text.count(p) or p not in got.split("\n")[0]


def test_classification(spark):
    kinds = {"/a/README.md": "natural_language", "/a/x.py": "code", "/a/x.json": "config", "/a/x.weird": "unknown", "/a/LICENSE": "natural_language", "/a/.env": None}
    text = "Some prose here."
    for path, kind in kinds.items():
        if kind:
            assert value(spark, classify.kind_of(F.col("p"), F.col("t")), p=path, t=text) == kind
    assert each(spark, classify.is_json, ['{"a":1}', '{"a":1} x', "12", "1, 2", "", '"' + "x" * 10_001 + '"']) == [True, False, True, False, False, False]
    assert each(spark, classify.is_yaml, ["a: 1\nb: 2\n- c: d", "prose\nmore", ""]) == [True, False, False]
    assert each(spark, classify.is_code, ["import os\ndef f():\n}", "prose\nmore"]) == [True, False]
    sensitive = ["/a/.env", "/a/.env.local", "/h/.ssh/config", "/a/api-key.txt", "/a/id_rsa", "/a/server.PEM", "/a/notes.md", "/a/environment.md"]
    assert each(spark, classify.is_sensitive, sensitive) == [True] * 6 + [False] * 2


HOOK = {"/terse": "full", "/terse lite": "lite", "/terse wenyan-full": "wenyan", "/terse nope": None, "/terse off": "off", "/terse-commit": "commit", "/terse:terse ultra": "ultra", "stop terse": "off", "activate terse": "full", "be brief please": "full", "don't start terse, stop": "off", "normal mode": "off", "hello": None, "/terse-stats --all": None, "stop being brief, be brief": None}
PLUGIN = {'"/terse ultra"\n': "ultra", "activate terse mode: wenyan-lite": "wenyan-lite", "activate terse mode: off": "off", "Activate terse mode:": "full", "`/terse lite`": "lite", "be brief": None, "stop talking like terse": "off", "/terse nope": None, "": None}


def test_command_dialects(spark):
    assert dict(zip(HOOK, each(spark, commands.hook_command, list(HOOK)), strict=True)) == HOOK
    assert dict(zip(PLUGIN, each(spark, commands.plugin_command, list(PLUGIN)), strict=True)) == PLUGIN
    assert each(spark, lambda c: commands.hook_command(c, "off"), ["activate terse"]) == [None]
    s = value(spark, commands.stats_command(F.col("p")), p="/terse-stats --share --since 7d")
    assert (s["is_stats"], s["share"], s["all"], s["since"]) == (True, True, False, "7d")
    assert each(spark, commands.duration_ms, ["7d", "12h", "x", "3m", ""]) == [604_800_000, 43_200_000, None, None, None]
    assert each(spark, commands.valid, [" Full ", "\tlite\n", "nope", "x" * 70, None]) == ["full", "lite", None, None, None]


def test_white_space_of_all_kinds(spark):
    prompts = {"\t/terse lite": "lite", "\n/terse lite\n": "lite", "\u00a0stop terse\u2003": "off", "stop it\nand start terse": None, "\n\t": None}
    assert dict(zip(prompts, each(spark, commands.hook_command, list(prompts)), strict=True)) == prompts
    assert each(spark, commands.plugin_command, ["\n'/terse ultra'\t", "\t"]) == ["ultra", None]
    assert each(spark, spaces.blank, ["\n\t \u3000", "", "x", None]) == [True, True, False, None]
    refused = lambda c: classify.refusal(F.lit("/w/a.md"), c, F.lit("\n\t"))
    assert each(spark, refused, ["\n\t\n", "text"]) == ["empty input", "empty output"]
    assert each(spark, classify.is_yaml, ["a: 1\n\t\n\t\n\t\nb: 2"]) == [True]
    assert each(spark, markdown.headings, ["# a\u00a0\t"])[0][0]["title"] == "a"


def check(spark, a, b):
    return validation.judged(spark.createDataFrame([(a, b)], "original string, compressed string")).first()


def test_validation_rules(spark):
    assert check(spark, MARKDOWN, MARKDOWN).is_valid
    lost = check(spark, "`a` `a` `b`", "`a` `c`")
    assert not lost.is_valid and lost.errors == ["Inline code lost: [a (lost 1 of 2 occurrences), b]"] and lost.warnings == ["Inline code added: [c]"]
    assert check(spark, "`a`", "`a` `a`").warnings == []
    both = check(spark, "# A\n# B", "# A")
    assert both.errors == ["Heading count mismatch: 2 vs 1"] and both.warnings == ["Heading text/order changed"]
    assert check(spark, "x https://a.b", "x").errors == ["URL mismatch: lost=[https://a.b], added=[]"]
    assert check(spark, "- a\n- b\n- c", "- a").warnings == ["Bullet count changed too much: 3 -> 1"]
    assert check(spark, "```\nx\n```", "```\ny\n```").errors[0] == "Code blocks not preserved exactly"
    assert check(spark, "# A\r\nx", "# A\nx").is_valid


def test_json(spark):
    assert each(spark, jsonx.without_comments, ['{"a": "//x", /* c */ "b": [1, 2,], // d\n}']) == ['{"a": "//x",  "b": [1, 2] \n}']
    parsed = each(spark, lambda c: F.try_variant_get(jsonx.parsed(c), "$.a", "string"), ['{"a": 1}', '{"a": 2, // x\n}', "", "nope"])
    assert parsed == ["1", "2", None, None]
    deep = jsonx.deep_rewriter(("description", "note"))
    got = each(spark, lambda c: deep(c), ['{"x":[{"description":"the item","note":"just a","name":"the"}],"description":{"the":1}}', "the bad line", None])
    assert got == ['{"x":[{"description":"item","note":"","name":"the"}],"description":{"the":1}}', "the bad line", None]


def test_lint(spark):
    assert each(spark, lint.commit_violations, ["fix: repair", "Fixed things.", "feat: added more", "docs: " + "x" * 50, "docs: " + "x" * 80]) == [[], ["type", "period"], ["mood"], ["over 50"], ["over 72"]]
    assert each(spark, lint.shell_tokens, ["node \"/a b/c.js\" 'x y' --z"]) == [["node", "/a b/c.js", "x y", "--z"]]
    assert each(spark, lambda c: lint.expanded(c, "/h"), ["$HOME/a", "~/b", "~", "a~b"]) == ["/h/a", "/h/b", "/h", "a~b"]
    assert each(spark, lint.plain_description, ["a", "a <b>"]) == [True, False]


MESSAGE = '{"jsonrpc":"2.0","id":7,"result":{"tools":[{"name":"the n","description":"The item","inputSchema":{"p":{"description":"the inner"}}}],"nextCursor":"c","size":1.0}}'


def test_rewritten_messages_keep_their_fields(spark):
    nested = '{"id":1.5,"result":{"tools":[{"description":"item","inputSchema":{"description":"the inner"}}],"resources":[null,3,{"description":null}]}}'
    others = ['{"id":1}', "not {json", '{"result":null}', '{"result":[{"description":"the a"}]}', "[1,2]", "null", '{"a":NaN}', None]
    got = each(spark, jsonx.rewritten, [MESSAGE, nested, *others])
    assert got[0] == MESSAGE.replace("The item", "item").replace("1.0}}", "1}}")
    assert got[1] == nested.replace("the inner", "inner")
    assert got[2:] == ['{"id":1}', "not {json", '{"result":null}', '{"result":[{"description":""}]}', "[1,2]", "null", '{"a":NaN}', None]
    assert each(spark, jsonx.rewriter(("note",)), ['{"result":{"tools":[{"note":"the a b","description":"the x"}]}}']) == ['{"result":{"tools":[{"note":"b","description":"the x"}]}}']
    assert jsonx.field_list(" a, ,b") == ("a", "b") and jsonx.field_list(None) == ("description",)


def test_settings_keep_their_fields(spark):
    text = '{"model":"m", // c\n"hooks":{"Start":[{"matcher":"x","own":[1],"hooks":[{"type":"command","command":"node terse.js","async":true},{"type":"command","command":""}]},{"odd":1}],"Stop":[{"hooks":[{"type":"agent","prompt":"p"}]}]},}'
    one = lambda f: each(spark, f, [text])[0]
    got = one(jsonx.settings_sound())
    assert got["changed"] == 1 and got["settings"] == '{"model":"m","hooks":{"Start":[{"matcher":"x","own":[1],"hooks":[{"type":"command","command":"node terse.js","async":true}]}],"Stop":[{"hooks":[{"type":"agent","prompt":"p"}]}]}}'
    got = one(jsonx.settings_without("terse"))
    assert got["changed"] == 1 and '"async"' not in got["settings"] and '"own":[1]' in got["settings"]
    assert each(spark, jsonx.settings_without("p"), ['{"hooks":{"S":[{"hooks":[{"command":"p"}]}]},"x":1}'])[0]["settings"] == '{"x":1}'
    add = jsonx.settings_with("Start", "node b", "terse")
    assert tuple(one(add)) == (text_without_comments(text), 0)
    assert [tuple(r) for r in each(spark, add, ["", "nope", '{"hooks":{"Start":7}}', None])] == [('{"hooks":{"Start":[{"hooks":[{"type":"command","command":"node b"}]}]}}', 1), ("nope", 0), ('{"hooks":{"Start":[{"hooks":[{"type":"command","command":"node b"}]}]}}', 1), (None, 0)]


def text_without_comments(text):
    import json

    return json.dumps(json.loads(text.replace(" // c\n", "").replace(",}", "}")), separators=(",", ":"))


LONG = {
    "word": "x" * 1_000_000, "dots": "a." * 500_000, "capitals": "A_" * 500_000, "lines": "\n" * 1_000_000, "spaces": " " * 1_000_000, "quotes": "`" * 1_000_000, "fences": "```\n" * 250_000, "hashes": "# " * 500_000,
    "bullets": "- \n" * 333_000, "slashes": "a/" * 500_000, "schemes": "https://" * 125_000, "string": '{"a": "' + "x" * 1_000_000 + '"}', "escapes": '{"a": "' + "\\\\" * 500_000 + '"}', "open": '"' + "x" * 1_000_000, "comments": "/*" * 500_000,
    "keys": "---\ntools:\n" + "  - a\n" * 160_000 + "---\nx", "starts": "activate " * 110_000, "prose": "the word of a text, just so. " * 35_000,
}
FUNCTIONS = {
    "compressed": lexical.compressed, "rephrased": lexical.rephrased, "headings": lambda c: F.size(markdown.headings(c)), "urls": lambda c: F.size(markdown.urls(c)), "paths": lambda c: F.size(markdown.paths(c)), "bullets": markdown.bullets, "codes": lambda c: F.size(markdown.inline_codes(c)),
    "blocks": lambda c: F.size(markdown.code_blocks(c)), "front": lambda c: markdown.front_matter(c)["front"], "loose": lambda c: markdown.front_matter_loose(c)["front"], "bare": markdown.body_only, "inner": lambda c: markdown.without_key_inside(c, "tools"), "key": lambda c: markdown.without_key(c, "tools"), "unwrapped": markdown.unwrapped,
    "block": lambda c: markdown.with_block(c, "<b>", "<e>", "x"), "cut": lambda c: markdown.without_block(c, "<b>", "<e>"), "comments": jsonx.without_comments, "parsed": lambda c: jsonx.parsed(c).isNull(), "rewritten": lambda c: jsonx.rewritten(c), "hook": commands.hook_command, "plugin": commands.plugin_command,
    "stats": lambda c: commands.stats_command(c)["is_stats"], "kind": lambda c: classify.kind_of(F.lit("/w/LICENSE"), c), "refusal": lambda c: classify.refusal(F.lit("/w/a.md"), c, F.lit("x")), "words": markdown.words, "preview": formatting.preview, "commit": lambda c: F.size(lint.commit_violations(c)), "review": lambda c: lint.review_line(c)["path"],
}


@pytest.mark.parametrize("name", sorted(FUNCTIONS))
def test_texts_of_a_megabyte(spark, name):
    """No text overflows the stack or takes time beyond its length."""
    import time

    df = spark.createDataFrame(list(LONG.items()), "k string, v string").repartition(4)
    start = time.time()
    assert df.select("k", FUNCTIONS[name](F.col("v")).alias("x")).agg(F.count("k"), F.max(F.length(F.col("x").cast("string")))).first()[0] == len(LONG)
    assert time.time() - start < 60


def test_tokens_and_environment(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    own.pre_tokenizer = pre_tokenizers.Whitespace()
    own.save(str(tmp_path / "t.json"))
    count = tokens.counter(str(tmp_path / "t.json"))
    assert each(spark, count, ["a b, c", "", None]) == [4, 0, None]
    assert each(spark, tokens.counter(), ["a b, c", ""]) == [3, 0]
    assert each(spark, lambda c: environment.switched_on(c, True), ["0", "", None, "1"]) == [False, True, True, True]
    assert each(spark, lambda c: environment.switched_on(c, False), ["0", "", None, "1"]) == [False, False, False, True]
    quoted = {"": '""', "plain": "plain", "a b": '"a b"', 'a"': '"a\\""', 'a\\" b\\': '"a\\\\\\" b\\\\"'}
    assert dict(zip(quoted, each(spark, formatting.windows_quoted, list(quoted)), strict=True)) == quoted
    assert each(spark, formatting.display_mode, ["wenyan", "lite", None]) == ["wenyan-full", "lite", None]
