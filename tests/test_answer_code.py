"""Code taken out of answers with and without fences."""

import pytest

from sparkeda.operators import chatlog

CASES = [
    ("Here:\n```python\nx = 1\n```\nand\n```python\ny\n```", "x = 1"), ("So\n```\nSELECT 1\n```", "SELECT 1"),
    ("Here is it\nMore words\nx = df.sum()\nPrint it", "x = df.sum()\nPrint it"), ("Use import os\nDone", "Use import os\nDone"),
    ("All prose.\nOnly prose.", "All prose.\nOnly prose."), ("Prose\n\nTail", "Tail"), ("Prose\n```\nInside\nMore", "Inside\nMore"),
    ("```\nA\n```x", "A"), ("  x = 1  ", "x = 1"), ("Ärger\nnp.sum", "np.sum"), ("", None), (None, None), (" \n ", None),
]


@pytest.mark.parametrize("text,code", CASES)
def test_cases(spark, text, code):
    log = spark.createDataFrame([(1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    assert [r["code"] for r in chatlog.answer_code(log).collect()] == ([] if code is None else [code])
