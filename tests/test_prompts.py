import pytest
from pyspark.sql import functions as F

from lodestone.functions import prompts as P

BODY = "networks are strong"
CASES = [
    ("None", None, None, BODY),
    ("SearchQuery", None, None, f"task: search result | query: {BODY}"),
    ("QuestionAnswering", None, None, f"task: question answering | query: {BODY}"),
    ("FactVerification", None, None, f"task: fact checking | query: {BODY}"),
    ("Classification", None, None, f"task: classification | query: {BODY}"),
    ("Clustering", None, None, f"task: clustering | query: {BODY}"),
    ("SemanticSimilarity", None, None, f"task: sentence similarity | query: {BODY}"),
    ("CodeRetrieval", None, None, f"task: code retrieval | query: {BODY}"),
    ("SearchDocument", " Doc ", "ignored", f"title: Doc | text: {BODY}"),
    ("SearchDocument", None, None, f"title: none | text: {BODY}"),
    ("SemanticSimilarity", None, " own ", f"task: own | query: {BODY}"),
    ("Unheard", None, "own", f"task: own | query: {BODY}"),
]


def test_prompts_agree_in_python_and_spark(spark):
    rows = [(i, t, f" 　{BODY}\u0085\n", title, d) for i, (t, title, d, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, task string, content string, title string, about string")
    got = df.select("i", P.prompt(F.col("task"), F.col("content"), F.col("title"), F.col("about")).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == [c[3] for c in CASES]
    assert [P.build_prompt(t, BODY, title, d) for t, title, d, _ in CASES] == [c[3] for c in CASES]


@pytest.mark.parametrize("task,content", [("SearchQuery", ""), ("None", " \t"), ("Unheard", BODY), ("SearchQuery", None)])
def test_bad_requests(spark, task, content):
    with pytest.raises(P.PromptError):
        P.build_prompt(task, content)
    df = spark.createDataFrame([(task, content)], "task string, content string")
    text, error = P.prompt_parts(F.col("task"), F.col("content"))
    r = df.select(text.alias("t"), error.alias("e")).first()
    assert r.t is None and r.e
    with pytest.raises(Exception, match="content is empty|no description"):
        df.select(P.prompt(F.col("task"), F.col("content")).alias("p")).collect()


def test_dims(spark):
    assert [P.resolve_dim(x) for x in (0, None, 768, 512, 256, 128)] == [512, 512, 768, 512, 256, 128]
    with pytest.raises(P.PromptError):
        P.resolve_dim(1024)
    df = spark.createDataFrame([(0,), (128,), (7,)], "d int")
    assert [r.x for r in df.select(P.dim_column(F.col("d"), False).alias("x")).collect()] == [512, 128, None]
    with pytest.raises(Exception, match="unsupported dimension"):
        df.select(P.dim_column(F.col("d")).alias("x")).collect()
