"""The text under the loss mask is what the spans cut out; short secrets are found and masked."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from test_operators import PART

from provgraph.llm import chat, pii


def test_loss_text_comes_from_the_spans(spark):
    """Placeholders of a masked turn fall out, and a span that is moved, longer or missing changes the text."""
    said = ["a<|b\\c<", "<|image|>é", "", "\\<\\|x|>\U0001f600"]
    rows = [(1, i, "assistant" if i % 2 else "user", [PART("text", t), PART("image", None, "x.png", 28, 28), PART("text", t + "!")]) for i, t in enumerate(said)]
    formatted = chat.format_conversations(spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{chat.PART}>"))
    want = "".join(said[i] + said[i] + "!" for i in (1, 3))
    assert chat.parse_conversations(formatted).first().loss_text == want
    moved = {
        "later": F.transform("loss_spans", lambda s: F.struct((s.start + 1).alias("start"), (s.end + 1).alias("end"))), "longer": F.transform("loss_spans", lambda s: F.struct(s.start.alias("start"), (s.end + 3).alias("end"))),
        "missing": F.slice("loss_spans", 1, 1), "of the user": F.transform("loss_spans", lambda s: F.struct(F.lit(len(chat.START) + 4 + len(chat.SEP)).alias("start"), F.lit(40).alias("end"))),
    }
    for spans in moved.values():
        assert chat.parse_conversations(formatted.withColumn("loss_spans", spans)).first().loss_text != want


def test_short_secrets(spark):
    """Right after a secret's name and a sign, of four characters or more and not letters alone; prose with the same words stays."""
    r = random.Random(17)
    word = lambda n: "".join(r.choice("abcdefghijklmnop0123456789") for _ in range(n))
    short = {0: "log in with password=hunter2 today", 1: "pwd: tr0ub4", 2: 'use "api_key": "k9-z" here.', 3: "the token = 12ab. Next"}
    secrets = {0: "hunter2", 1: "tr0ub4", 2: "k9-z", 3: "12ab"}
    clean = {10: "the password is long and the token: none of it", 11: "secret: agent, phone: 555 12", 12: "auth: yes; pwd: ab1", 13: "section: 12a4 of the page"}
    rows = list(short.items()) + list(clean.items()) + [(100 + i, f"password={word(5)} and secret: {word(20)} in some words of text") for i in range(200)] + [(400 + i, f"on page {i} of volume 2019-{i:04} see isbn 978-3-16-{i:06}-0 and commit {word(12)}") for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {x.doc_id: x.spans for x in pii.find_personal_data(table).collect()}
    masked = {x.doc_id: x.text for x in pii.mask_personal_data(table).collect()}
    for i, secret in secrets.items():
        at = short[i].index(secret)
        assert f"secret:{at}:{at + len(secret)}" in found[i].split(",") and secret not in masked[i]
    assert all(found[i] == "" and masked[i] == clean[i] for i in (10, 11, 12, 13))
