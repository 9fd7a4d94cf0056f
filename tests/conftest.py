import pytest

from verdictflow.schemas import POSTS
from verdictflow.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.driver.memory": "8g",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def setting(spark):
    """Change session settings for one test."""
    before = {}

    def change(key, value):
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def make_posts(spark):
    """Posts from (id, title, body, flair, hour) tuples."""

    def build(rows):
        return spark.createDataFrame(
            [
                (
                    str(number),
                    title,
                    body,
                    flair,
                    1704067200.0 + hour * 3600,
                    f"https://example.org/post/{number}",
                )
                for number, title, body, flair, hour in rows
            ],
            POSTS,
        )

    return build


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def nodes_of(df):
    """Names of the physical plan's nodes, without those of subqueries."""
    names, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        names.append(node.nodeName())
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return names
