"""Plans of requests, case by case."""

from millrace.functions import request_plan


def test_plans(spark):
    chat = ("CHAT", "safe_fallback", [], True)
    cases = [
        (None, "HUMAN_TASK", False, None, None, ("TRIVIAL", "empty_message", [], True)), (" \n", "CONTINUATION", True, "DEBUG", 0.9, ("TRIVIAL", "empty_message", [], True)),
        ("why is it broken", "HUMAN_TASK", False, None, None, ("DEBUG", "regex", ["GRAPH", "PATCH", "READ"], False)), ("find it", "HUMAN_TASK", False, None, None, ("SEARCH", "regex", ["GRAPH", "READ"], False)),
        ("find it", "CONTINUATION", False, None, None, ("SEARCH", "regex", ["GRAPH", "PATCH", "READ"], False)), ("find it", None, True, None, None, ("SEARCH", "regex", ["GRAPH", "PATCH", "READ"], False)),
        ("hello", "HUMAN_TASK", None, "DEBUG", 0.2, ("DEBUG", "semantic", ["GRAPH", "PATCH", "READ"], False)), ("hello", "HUMAN_TASK", False, "DEBUG", 0.19, chat), ("hello", "CONTINUATION", True, None, None, chat),
        ("hello main.py", "HUMAN_TASK", False, None, None, ("SEARCH", "context_signal", ["GRAPH", "READ"], False)), ("generate a scaffold", "HUMAN_TASK", False, None, None, ("CREATE", "regex", ["PATCH"], False)),
        ("add a new file", "HUMAN_TASK", False, None, None, ("CREATE", "regex", ["PATCH"], False)),
        ("create a new file and call it", "HUMAN_TASK", False, None, None, ("CREATE", "regex", ["GRAPH", "PATCH", "READ"], False)), ("ok, thanks, explain; remove it, looks good", "HUMAN_TASK", True, None, None, ("PATCH", "regex", ["PATCH"], False)),
    ]
    df = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "i int, text string, origin string, prior_tools boolean, near_intent string, near_score double")
    got = {r["i"]: (r["intent"], r["method"], r["capabilities"], r["bypass"]) for r in request_plan.plan(df).collect()}
    assert {i: (cases[i][0], g) for i, g in got.items() if g != cases[i][5]} == {} and len(got) == len(cases)
    assert request_plan.plan(df.limit(0)).count() == 0
