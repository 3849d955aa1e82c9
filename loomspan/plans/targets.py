"""Queries on contracts of JSON documents: valid documents with the parts' names in them, and one fault at a time for every rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import contracts
from loomspan.sources.tables import dealt, table

Faults = Sequence[tuple[str, str, str | None]]


def _with(valid: str, faults: Faults) -> list[tuple[str, str | None]]:
    """(document as SQL, the rule it breaks) of a valid document and of its faults; NAME stands for the part's name."""
    sql = lambda text: "'" + text.replace("'", "''").replace("NAME", "' || p_name || '") + "'"
    for find, _, _ in faults:
        if find not in valid:
            raise ValueError(find)
    return [(sql(valid), None), *((sql(valid.replace(find, put, 1)), name) for find, put, name in faults)]


def _case(values: Sequence[str]) -> str:
    return f"CASE p_partkey % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


def _texts(cases: Sequence[tuple]) -> str:
    return _case([c[0] for c in cases])


def _quoted(cases: Sequence[tuple], k: int) -> str:
    return _case([f"'{c[k]}'" if c[k] is not None else "NULL" for c in cases])


_JOINT = '{"prediction1_units":["action","segment"],"prediction2_units":["action"],"plan_units":["action","segment"]}'
_SINGLE = '{"prediction1_units":["action"],"prediction2_units":[],"plan_units":["action"]}'
_PLANNED = '{"prediction1_units":[],"prediction2_units":[],"plan_units":["action","segment"]}'
_UNIT = '{"available":true,"caption":"pick NAME","progress_percent":10}'
_PREDICTIONS = f'[{{"index":1,"role":"current","action":{_UNIT},"segment":{{"available":true,"caption":"hold it","progress_percent":100}}}},{{"index":2,"role":"next","action":{{"available":true,"caption":"place it","progress_percent":0}}}}]'
_ONGOING = f'{{"task_progress_percent":40,"predictions":{_PREDICTIONS},"execution_decision":"Continue","decision_detail":null}}'
_PLAN = '[{"index":1,"action":{"caption":"pick NAME","segments":[{"index":1,"segment":{"caption":"go"}},{"index":2,"segment":{"caption":"grasp 1.5 kg"}}]}},{"index":2,"action":{"caption":"place it","segments":[]}}]'
_SHORT_PLAN = '[{"index":1,"action":{"caption":"pick NAME"}}]'
_REPLAN = f'{{"execution_decision":"Replan","decision_detail":{{"reason":"it fell","updated_plan":{_SHORT_PLAN}}}}}'
_TAKEOVER = f'{{"execution_decision":"Takeover","decision_detail":{{"failure_analysis":{{"failed_action_context":"a","expected_action":"pick NAME","observed_failure":"it fell","failure_type":"The object is not grasped"}},"recovery_plan":{_SHORT_PLAN}}}}}'
_END = f'{{"task_progress_percent":100,"predictions":{_PREDICTIONS},"execution_decision":"End","decision_detail":{{"outcome":"completed"}}}}'


def _of(category: str | None, spec: str, cases: list[tuple[str, str | None]]) -> list[tuple]:
    return [(text, category, spec, name) for text, name in cases]


_TARGETS = [
    *_of("ongoing", _JOINT, _with(_ONGOING, [
        ('"task_progress_percent":40', '"task_progress_percent":140', "task_progress"), (":40", ":true", "task_progress"), (":40", ":40.5", "task_progress"), ('"role":"next"', '"role":"current"', "prediction_role"), ('"index":2', '"index":1', "prediction_role"),
        ('"progress_percent":0}', '"progress_percent":5}', "next_progress"), ('"Continue"', '"End"', "decision_of_category"), ('"Continue"', '"Stop"', "decision"), ("null}", "{}}", "continue_detail"), (":100", ":101", "unit_progress"),
        ("pick", "the subtask", "text_forbidden_term"), ("pick", "L2", "text_forbidden_term"), ("pick", "turn 1.5 kg of", None), ("pick", "case 1.5 with", "text_failure_code"), ("pick", "11.5", None), ('"pick NAME"', "7", "text_no_string"), ('"pick NAME"', '"  "', "text_empty"),
        ('"pick NAME"', '"17 !"', "text_not_english"), ("pick", "拿 pick", "text_cjk"), ('"available":true', '"available":false', "unit_not_available"), ('"available":true', '"available":"true"', "unit_available"), ('"available":true,"caption":"pick NAME"', '"caption":"pick NAME","available":true', "unit_names"),
        ('"index":1,"role":"current"', '"role":"current","index":1', "prediction_names"), (',"segment":', ',"other":', "prediction_names"), ('"task_progress_percent":40,', "", "target_names"), (_PREDICTIONS, "[]", "two_predictions"), (_PREDICTIONS, "{}", "two_predictions"), (_ONGOING, "[1]", "target_no_object"), (_ONGOING, "{", "target_no_object"),
    ])),
    *_of("initial_plan", _PLANNED, _with(f'{{"initial_plan":{_PLAN}}}', [
        ('{"index":2,"action"', '{"index":3,"action"', "action_index"), ('"index":1,"action"', '"action"', "action_names"), ('"index":2,"segment"', '"index":"2","segment"', "segment_index"), ('{"index":1,"segment"', '{"segment"', "segment_names"), ('"segment":{"caption":"go"}', '"segment":"go"', "segment_object"),
        ('"segments":[]', '"segments":"none"', "segments_no_list"), (',"segments":[]', "", "action_object"), ('"go"', '"3.1"', "text_not_english"), ('"go"', '"see 3.1 here"', "text_failure_code"), (_PLAN, "[]", "initial_plan_empty"), (_PLAN, "null", "initial_plan_empty"), ('{"initial_plan"', '{"plan"', "target_names"),
    ])),
    *_of("replan", _SINGLE, _with(_REPLAN, [('"Replan"', '"Continue"', "decision_of_category"), ('"reason":"it fell",', "", "replan_names"), ('"it fell"', '""', "text_empty"), (_SHORT_PLAN, "[]", "updated_plan_empty"), ('"execution_decision":"Replan",', "", "target_names"), ('{"caption":"pick NAME"}', '{"caption":"pick NAME","segments":[]}', "action_object")])),
    *_of("takeover", _SINGLE, _with(_TAKEOVER, [('"The object is not grasped"', '"Unknown"', "failure_type"), ('"failed_action_context":"a",', "", "failure_names"), ('"recovery_plan"', '"plan"', "takeover_names"), (_SHORT_PLAN, "7", "recovery_plan_empty"), ('"Takeover"', '"Replan"', "decision_of_category")])),
    *_of("end", _JOINT, _with(_END, [('"completed"', '"done"', "end_outcome"), ('"completed"', '"terminated"', None), ('"outcome"', '"result"', "end_names"), ('{"outcome":"completed"}', "null", "detail_no_object"), ('"End"', '"Continue"', "decision_of_category")])),
    *_of("other", _SINGLE, _with("{}", [])[:1]),
    *_of(None, _SINGLE, _with("{}", [])[:1]),
    *_of("ongoing", _SINGLE.replace('["action"]', '["segment"]'), _with(_ONGOING, [])),
]
_TARGETS = [(*t[:3], "category") if t[1] in ("other", None) else (*t[:3], "spec_plan_profile") if '"plan_units":["segment"]' in t[2] else t for t in _TARGETS]

_SPECS = [
    *((s, c, None) for s, c in ((_JOINT, "ongoing"), (_SINGLE, "end"), (_PLANNED, "initial_plan"), (_PLANNED, "none"))),
    (_JOINT.replace('["action","segment"],"pred', '["segment","action"],"pred'), "ongoing", "prediction1_units_order"), (_SINGLE.replace('_units":[]', '_units":["view"]'), "ongoing", "prediction2_units_unknown_or_repeated"),
    (_SINGLE.replace('_units":[]', '_units":["action","action"]'), "ongoing", "prediction2_units_unknown_or_repeated"), (_SINGLE.replace('_units":[]', '_units":"action"'), "ongoing", "prediction2_units_no_list"), ("[]", "ongoing", "spec_no_object"), (_SINGLE.replace("plan_units", "plan"), "ongoing", "spec_names"),
    (_SINGLE, "initial_plan", "spec_predictions_of_plan"), (_PLANNED.replace('"action",', ""), "initial_plan", "spec_plan_without_action"), (_PLANNED, "end", "spec_without_prediction"), (_JOINT.replace('s":["action","segment"]}', 's":["segment"]}'), "replan", "spec_plan_profile"),
]
_LONG = '[{"index":1,"action":"pick NAME"},{"index":2,"action":"place it","segment":"go"},{"index":3,"segment":"go"}]'
_SHORT = f'{{"task_progress_percent":3,"prediction1":{{"action":{_UNIT}}}}}'
_MEMORIES = f'{{"long_memory":{_LONG},"short_memory":{_SHORT}}}'
_WHOLE = f'{{"initial_plan_memory":{_PLAN},"long_memory":[],"short_memory":null}}'


def _in(context: str, category: str, cases: list[tuple[str, str | None]]) -> list[tuple]:
    return [(text, context, category, name) for text, name in cases]


_CONTEXTS = [
    *_in("with_memory_no_initial", "ongoing", _with(_MEMORIES, [
        ('"index":1', '"index":2', "memory_index"), ('{"index":1,"action"', '{"action"', "memory_item"), ('{"index":1,"action":"pick NAME"}', '{"index":1}', "memory_units"), ('"action":"place it","segment":"go"', '"segment":"go","action":"place it"', "memory_units"), ('"place it"', '"7"', "text_not_english"),
        ('"segment":"go"}]', '"action":"PICK NAME"}]', "long_memory_repeated"), (_LONG, '"none"', "long_memory_no_list"), (_LONG, "[" + ",".join(f'{{"index":{k},"action":"a{k}"}}' for k in range(1, 10)) + "]", "long_memory_size"),
        (_SHORT, "null", None), (_SHORT, "{}", "short_memory_names"), ('"prediction1":{"action":' + _UNIT + "}", '"prediction1":{}', "short_memory_units"), ('percent":3,', 'percent":-3,', "task_progress"), (":10", ":1000", "unit_progress"), ('"long_memory"', '"memory"', "context_names"),
    ])),
    *_in("with_memory_with_initial_noisy", "end", _with(_WHOLE, [(_PLAN, "[]", "initial_plan_memory_empty"), ('"index":1,"action"', '"index":0,"action"', "action_index"), (',"short_memory":null', "", "context_names")])),
    *_in("no_memory_no_initial", "ongoing", _with("{}", [("{}", _MEMORIES, "context_names"), ("{}", "[]", "context_no_object")])),
    *_in("with_memory_no_initial", "initial_plan", [(_with(_MEMORIES, [])[0][0], "context_of_plan")]),
    *_in("some_memory", "ongoing", [("'{}'", "context_unknown")]),
]

_LEVEL = '{"level":"L1","caption":"pick NAME","progress_percent":5}'
_WINDOW = f'{{"task":{{"level":"L3","caption":"sort","progress_percent":9}},"predictions":[{{"index":1,"action":{_LEVEL},"l0":{{"level":"L0","source":"segment","caption":"go","progress_percent":1}}}},{{"index":2,"action":{{"level":"L1","caption":"place it","progress_percent":0}},"l0":{{"level":"L0","source":"human_segment","caption":"hold","progress_percent":0}}}}]}}'
_LAST = _WINDOW.replace("place it", contracts.TERMINAL).replace("hold", contracts.TERMINAL)


def _as(profile: str, ends: bool, cases: list[tuple[str, str | None]]) -> list[tuple]:
    return [(text, profile, str(ends).lower(), name) for text, name in cases]


_WINDOWS = [
    *_as("L3L1L0", False, _with(_WINDOW, [
        ('"index":1', '"index":2', "prediction_index"), ('"level":"L1"', '"level":"L2"', "level"), ('"source":"segment"', '"source":"auto"', "source"), ('"source":"segment",', "", "level_names"), ('"pick NAME"', '"unknown"', "caption"), (":5}", ":500}", "progress"), (':0},"l0"', ':1},"l0"', "next_progress"),
        ('"level":"L3"', '"level":"L2"', "task_level"), (":9}", ':"9"}', "task_progress"), ('"caption":"sort",', "", "task_names"), ('"task"', '"job"', "target_names"), ('"sort"', '"语 sort"', "caption"), ("place it", contracts.TERMINAL, "window_end"), ("hold", contracts.TERMINAL, "terminal_inside"), ('"action":', '"subtask":', "prediction_names"),
    ])),
    *_as("L3L1L0", True, _with(_LAST, [('"human_segment","caption":"' + contracts.TERMINAL, '"human_segment","caption":"hold', "terminal_caption")])),
    *_as("L3L1", False, _with(_WINDOW, [])[:1]), *_as("L4", False, _with(_WINDOW, [])[:1]),
    *_as("L3L1L0", False, _with(_WINDOW[: _WINDOW.index(',{"index":2')] + "]}", [])),
]
_WINDOWS = [(*w[:3], "prediction_names") if w[1] == "L3L1" else (*w[:3], "profile") if w[1] == "L4" else (*w[:3], "predictions_expected") if '"index":2' not in w[0] else w for w in _WINDOWS]
_TREE = '{"task":{"level":"L3","caption":"sort"},"initial_plan":[{"index":1,"subtask":{"level":"L2","caption":"clear NAME","actions":[{"index":1,"action":{"level":"L1","caption":"pick","segments":[{"index":1,"l0":{"level":"L0","source":"segment","caption":"go"}}]}}]}}]}'
_TREES = [
    *((t, "full", n) for t, n in _with(_TREE, [
        ('"segments":[{"index":1', '"segments":[{"index":2', "plan_index"), ('"actions":[{"index":1,', '"actions":[{', "plan_names"), ('"source":"segment",', "", "level_names"), ('[{"index":1,"l0":{"level":"L0","source":"segment","caption":"go"}}]', "[]", "children"), ('"clear NAME"', '""', "caption"), ('"level":"L0"', '"level":"L1"', "level"),
        ('"caption":"sort"', '"title":"sort"', "task_names"), ('"initial_plan":[', '"initial_plan":[5,', "plan_names"), ('"initial_plan"', '"plan"', "target_names"), ('"source":"segment"', '"source":7', "source"),
    ])),
    (_with(_TREE, [])[0][0], "L3L2", "level_names"), ("'{\"task\":{\"level\":\"L3\",\"caption\":\"sort\"},\"initial_plan\":[]}'", "L3L2", "plan_empty"),
]


def _judged(spark: SparkSession, sf_dir: str, name: Column) -> DataFrame:
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", name.alias("rule"))


def target_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each model output breaks, by category and output spec."""
    return _judged(spark, sf_dir, contracts.target(F.expr(_texts(_TARGETS)), F.expr(_quoted(_TARGETS, 1)), F.expr(_quoted(_TARGETS, 2))))


def spec_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each output spec breaks, and the ids of those that keep to theirs."""
    spec = F.expr(_quoted(_SPECS, 0))
    return dealt(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", contracts.output_spec(spec, F.expr(_quoted(_SPECS, 1))).alias("rule"), contracts.profile_id(spec).alias("profile_id"))


def prompt_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each prompt's context breaks."""
    return _judged(spark, sf_dir, contracts.prompt_context(F.expr(_texts(_CONTEXTS)), F.expr(_quoted(_CONTEXTS, 1)), F.expr(_quoted(_CONTEXTS, 2)), F.lit(_JOINT)))


def window_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each window's target breaks."""
    return _judged(spark, sf_dir, contracts.window_target(F.expr(_texts(_WINDOWS)), F.expr(_quoted(_WINDOWS, 1)), F.expr(_case([w[2] for w in _WINDOWS]))))


def plan_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each nested plan breaks."""
    return _judged(spark, sf_dir, contracts.level_plan(F.expr(_texts(_TREES)), F.expr(_quoted(_TREES, 1))))


QUERIES = {f.__name__: f for f in (target_contract, spec_contract, prompt_contract, window_contract, plan_contract)}
_IDS = ["p1-action-segment__p2-action__plan-action-segment", "p1-action__p2-none__plan-action", "p1-none__p2-none__plan-action-segment", "p1-none__p2-none__plan-action-segment", None, None, None, None, None, None, "p1-action__p2-none__plan-action", "p1-none__p2-none__plan-segment", "p1-none__p2-none__plan-action-segment", "p1-action-segment__p2-action__plan-segment"]
ORACLES = {
    "target_contract": f"SELECT p_partkey, {_quoted(_TARGETS, 3)} AS rule FROM part",
    "spec_contract": f"SELECT p_partkey, {_quoted(_SPECS, 2)} AS rule, {_quoted([(i,) for i in _IDS], 0)} AS profile_id FROM part",
    "prompt_contract": f"SELECT p_partkey, {_quoted(_CONTEXTS, 3)} AS rule FROM part",
    "window_contract": f"SELECT p_partkey, {_quoted(_WINDOWS, 3)} AS rule FROM part",
    "plan_contract": f"SELECT p_partkey, {_quoted(_TREES, 2)} AS rule FROM part",
}
