"""Contracts of JSON documents: one Column that names the first rule a document breaks.

A contract is a list of rules, each a name and what has to hold, in the order in which
they are asked; nested ones are asked of each element of a list in turn. Rules look at
types as the JSON has them, at the order of an object's names, and at values. A document
that keeps to all has null. Everything is built-in functions over the text and its
parsed form, so a contract is one expression of a scan. A part is taken out of its
document once, whatever number of rules look at it (``once``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.text import bound, folded, is_latin_caption

# Fields of the profiles, levels of the fields, decisions of the categories and names of the contexts.
PROFILES = {
    "full": ("subtask", "action", "l0"),
    "L3L2L1": ("subtask", "action"),
    "L3L2L0": ("subtask", "l0"),
    "L3L2": ("subtask",),
    "L3L1L0": ("action", "l0"),
    "L3L1": ("action",),
    "L3L0": ("l0",),
}
LEVELS = {"subtask": "L2", "action": "L1", "l0": "L0"}
CHILDREN = {"action": "actions", "l0": "segments"}
TERMINAL = "the task is complete"
UNITS = ("action", "segment")
DECISIONS = {"ongoing": ("Continue", "Replan"), "end": ("End",), "takeover": ("Takeover",), "replan": ("Replan",)}
CONTEXTS = {
    "no_memory_no_initial": (),
    "with_memory_no_initial": ("long_memory", "short_memory"),
    "with_memory_with_initial": ("initial_plan_memory", "long_memory", "short_memory"),
    "with_memory_no_initial_noisy": ("long_memory", "short_memory"),
    "with_memory_with_initial_noisy": ("initial_plan_memory", "long_memory", "short_memory"),
}
MEMORY = 8
_FAILURES = (
    "Arm remains stationary instead of approaching the object", "Arm remains stationary above the object without grasping", "Arm remains stationary after grasping the object",
    "Arm moves back and forth without manipulating the object", "Arm does not retract after completing the task", "Wrong object is grasped", "An already placed object is grasped",
    "Operations are executed in the wrong order", "The object is not grasped", "The object is released unexpectedly after grasping", "Repeated grasp attempts fail", "The object is placed at the wrong location",
    "The object is dropped during transport", "The gripper cannot release the object", "The arm collides with another object during motion",
)
# Terms that a model must not see, codes of failures, and units behind which such a number is a quantity.
_TERMS = r"(?iU)\bsubtask\b|\bL[0-3]\b|\bprofile\b"
_CODE = (
    r"(?iU)(?<!\d)[1-8]\.[1-5](?!\d)(?!\s*-?\s*(?:(?:milliseconds?|seconds?|minutes?|hours?|ms|milligrams?|grams?|kilograms?|mg|g|kg|millimeters?|centimeters?|meters?|millimetres?|centimetres?|metres?|mm|cm|m"
    r"|milliliters?|liters?|millilitres?|litres?|ml|l|degrees?|radians?|rad|turns?|circles?|rotations?|times?|x|percent|fps|hz|newtons?|n)\b|%))"
)


@dataclass
class Node:
    """A part of a document: its text (of strings the string) and its parsed form."""

    text: Column
    value: Column

    def at(self, name: str) -> Node:
        return Node(F.get_json_object(self.text, f"$.{name}"), F.try_variant_get(self.value, f"$.{name}", "variant"))

    def kind(self) -> Column:
        return F.coalesce(F.schema_of_variant(self.value), F.lit(""))

    def is_object(self) -> Column:
        return F.startswith(self.kind(), F.lit("OBJECT"))

    def is_list(self) -> Column:
        return F.startswith(self.kind(), F.lit("ARRAY"))

    def names(self) -> Column:
        return F.coalesce(F.when(self.is_object(), F.json_object_keys(self.text)), F.array().cast("array<string>"))

    def has(self, names: Sequence[str]) -> Column:
        """The object's names, in this order, and no others."""
        return self.is_object() & (self.names() == F.array(*map(F.lit, names)).cast("array<string>"))

    def string(self) -> Column:
        return F.when(self.kind() == "STRING", F.try_variant_get(self.value, "$", "string"))

    def whole(self) -> Column:
        return F.when(self.kind() == "BIGINT", F.try_variant_get(self.value, "$", "bigint"))

    def items(self) -> Column:
        """The elements of a list as (text, value); none of anything else."""
        both = F.arrays_zip(F.from_json(self.text, "array<string>").alias("text"), F.try_variant_get(self.value, "$", "array<variant>").alias("value"))
        none = F.array().cast("array<struct<text:string,value:variant>>")
        return F.when(self.is_list(), F.coalesce(both, none)).otherwise(none)


def document(text: Column) -> Node:
    return Node(text, F.try_parse_json(text))


def once(rules: Callable[..., Column]) -> Callable[..., Column]:
    """Rules of a node that is worked out once for all of them."""

    @wraps(rules)
    def own(node: Node, *more, **named) -> Column:
        return bound(F.struct(node.text.alias("text"), node.value.alias("value")), lambda x: rules(Node(x["text"], x["value"]), *more, **named))

    return own


def parsed(rules: Callable[..., Column]) -> Callable[..., Column]:
    """Rules of a node as rules of a document's text, which is parsed once; what else they are given is worked out once too."""

    @wraps(rules)
    def own(text: Column, *more: Column | None) -> Column:
        node = document(text)
        given = F.struct(node.text.alias("text"), node.value.alias("value"), *(c.alias(f"c{k}") for k, c in enumerate(more) if c is not None))
        return bound(given, lambda x: rules(Node(x["text"], x["value"]), *(None if c is None else x[f"c{k}"] for k, c in enumerate(more))))

    return own


def rule(name: str, holds: Column) -> Column:
    """The name where the rule doesn't hold, or can't be told to."""
    return F.when(~F.coalesce(holds, F.lit(False)), F.lit(name))


def first(*rules: Column) -> Column:
    return F.coalesce(*rules, F.lit(None).cast("string"))


def each(node: Node, rules: Callable[[Node, Column], Column]) -> Column:
    """The first rule that an element of a list breaks; elements count from 1."""
    broken = F.transform(node.items(), lambda x, i: rules(Node(x["text"], x["value"]), i + 1))
    return F.get(F.filter(broken, lambda x: x.isNotNull()), F.lit(0))


def when(condition: Column, rules: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), rules)


@once
def _progress(node: Node, name: str = "progress") -> Column:
    return rule(name, node.whole().between(0, 100))


@once
def visible_text(node: Node) -> Column:
    """A string that a model may see: English, without terms and codes of the data's makers."""
    return bound(node.string(), lambda text: first(
        rule("text_no_string", text.isNotNull()),
        rule("text_empty", text.rlike(r"(?U)\S")),
        rule("text_not_english", text.rlike("[A-Za-z]")),
        rule("text_cjk", ~text.rlike("[㐀-鿿]")),
        rule("text_forbidden_term", ~text.rlike(_TERMS)),
        rule("text_failure_code", ~text.rlike(_CODE)),
    ))


@once
def _caption(node: Node) -> Column:
    return bound(node.string(), lambda text: rule("caption", is_latin_caption(text) & text.isNotNull()))


@once
def units(node: Node, name: str) -> Column:
    """A list of distinct units in their order."""
    known = F.array(*map(F.lit, UNITS))
    return bound(F.from_json(node.text, "array<string>"), lambda held: first(
        rule(f"{name}_no_list", node.is_list()),
        rule(f"{name}_unknown_or_repeated", (F.size(F.array_distinct(held)) == F.size(held)) & (F.size(F.array_except(held, known)) == 0)),
        rule(f"{name}_order", held == F.filter(known, lambda u: F.array_contains(held, u))),
    ))


_SPEC = ("prediction1_units", "prediction2_units", "plan_units")


@parsed
def output_spec(node: Node, category: Column) -> Column:
    """What is asked of a model: units of both predictions and of the plan, as the category allows them."""
    lists = F.struct(*(F.from_json(node.at(c).text, "array<string>").alias(c) for c in _SPEC))
    return bound(lists, lambda x: _spec_rules(node, category, *(x[c] for c in _SPEC)))


def _spec_rules(node: Node, category: Column, one: Column, two: Column, plan: Column) -> Column:
    none = F.array().cast("array<string>")
    return first(
        rule("spec_no_object", node.is_object()),
        rule("spec_names", node.has(_SPEC)),
        *(units(node.at(c), c) for c in _SPEC),
        when(category == "initial_plan", first(rule("spec_predictions_of_plan", (one == none) & (two == none)), rule("spec_plan_without_action", F.array_contains(plan, "action")))),
        when(category.isin(*DECISIONS), first(rule("spec_without_prediction", one != none), rule("spec_plan_profile", (F.element_at(plan, 1) == "action") & (F.size(plan) <= 2)))),
    )


@parsed
def profile_id(node: Node) -> Column:
    """p1-..__p2-..__plan-.. of an output spec that keeps its contract; null for others."""
    said = lambda c: F.array_join(F.from_json(node.at(c).text, "array<string>"), "-")
    name = F.concat(*(x for mark, c in zip(("p1-", "__p2-", "__plan-"), _SPEC, strict=True) for x in (F.lit(mark), F.when(said(c) == "", "none").otherwise(said(c)))))
    return F.when(output_spec(node.text, F.lit("")).isNull(), name)


@once
def plan(node: Node, joint: Column, name: str = "plan") -> Column:
    """A list of numbered actions with captions, and numbered segments where they are joint; not empty."""

    def segment(item: Node, k: Column) -> Column:
        inner = once(lambda own: first(rule("segment_object", own.has(("caption",))), visible_text(own.at("caption"))))
        return first(rule("segment_names", item.has(("index", "segment"))), rule("segment_index", item.at("index").whole() == k), inner(item.at("segment")))

    segments = once(lambda own: first(rule("segments_no_list", own.is_list()), each(own, segment)))

    @once
    def inner(own: Node) -> Column:
        return first(
            rule("action_object", F.when(joint, own.has(("caption", "segments"))).otherwise(own.has(("caption",)))),
            visible_text(own.at("caption")),
            when(joint, segments(own.at("segments"))),
        )

    def action(item: Node, k: Column) -> Column:
        return first(rule("action_names", item.has(("index", "action"))), rule("action_index", item.at("index").whole() == k), inner(item.at("action")))

    return first(rule(f"{name}_empty", node.is_list() & (F.size(node.items()) > 0)), each(node, action))


@once
def detail(node: Node, decision: Column, joint: Column) -> Column:
    """What goes with a decision: nothing, a new plan, a failure with a plan, or an outcome."""
    names = ("failed_action_context", "expected_action", "observed_failure", "failure_type")
    failed = once(lambda own: first(rule("failure_names", own.has(names)), *(visible_text(own.at(c)) for c in names), rule("failure_type", F.trim(own.at("failure_type").string()).isin(*_FAILURES))))
    return first(
        when(decision == "Continue", rule("continue_detail", F.coalesce(F.is_variant_null(node.value), F.lit(True)))),
        when(decision != "Continue", rule("detail_no_object", node.is_object())),
        when(decision == "Replan", first(rule("replan_names", node.has(("reason", "updated_plan"))), visible_text(node.at("reason")), plan(node.at("updated_plan"), joint, "updated_plan"))),
        when(
            decision == "Takeover",
            first(
                rule("takeover_names", node.has(("failure_analysis", "recovery_plan"))),
                failed(node.at("failure_analysis")),
                plan(node.at("recovery_plan"), joint, "recovery_plan"),
            ),
        ),
        when(decision == "End", first(rule("end_names", node.has(("outcome",))), rule("end_outcome", node.at("outcome").string().isin("completed", "terminated")))),
    )


@once
def _unit(node: Node) -> Column:
    """A unit that is there: a caption and its progress."""
    return first(
        rule("unit_names", node.has(("available", "caption", "progress_percent"))),
        rule("unit_available", node.at("available").kind() == "BOOLEAN"),
        _progress(node.at("progress_percent"), "unit_progress"),
        rule("unit_not_available", F.try_variant_get(node.at("available").value, "$", "boolean")),
        visible_text(node.at("caption")),
    )


@once
def predictions(node: Node, spec: Node) -> Column:
    """The current and the next prediction, each with the units that the spec asks for; the next one has no progress yet."""

    def one(item: Node, k: Column) -> Column:
        wanted = F.when(k == 1, F.from_json(spec.at(_SPEC[0]).text, "array<string>")).otherwise(F.from_json(spec.at(_SPEC[1]).text, "array<string>"))
        return bound(wanted, lambda wanted: rules(item, k, wanted))

    def rules(item: Node, k: Column, wanted: Column) -> Column:
        asked = lambda u: F.array_contains(wanted, u)
        names = F.concat(F.array(F.lit("index"), F.lit("role")), wanted)
        return first(
            rule("prediction_names", item.is_object() & (item.names() == names)),
            rule("prediction_role", (item.at("index").whole() == k) & (item.at("role").string() == F.when(k == 1, "current").otherwise("next"))),
            *(when(asked(u), _unit(item.at(u))) for u in UNITS),
            *(when((k == 2) & asked(u), rule("next_progress", item.at(u).at("progress_percent").whole() == 0)) for u in UNITS),
        )

    return first(rule("two_predictions", node.is_list() & (F.size(node.items()) == 2)), each(node, one))


@parsed
def target(node: Node, category: Column, spec: Column) -> Column:
    """A model's whole output by category: a plan, a decision alone, or progress, predictions and a decision."""
    asked = document(spec)
    shared = F.struct(asked.value.alias("asked"), F.array_contains(F.from_json(asked.at("plan_units").text, "array<string>"), "segment").alias("joint"), node.at("execution_decision").string().alias("decision"))
    return bound(shared, lambda x: _target_rules(node, category, Node(spec, x["asked"]), x["joint"], x["decision"]))


def _target_rules(node: Node, category: Column, asked: Node, joint: Column, decision: Column) -> Column:
    allowed = F.lit(False)
    for name, decisions in DECISIONS.items():
        allowed = F.when(category == name, decision.isin(*decisions)).otherwise(allowed)
    alone = category.isin("takeover", "replan")
    return first(
        rule("category", category.isin("initial_plan", *DECISIONS)),
        output_spec(asked.text, category),
        rule("target_no_object", node.is_object()),
        when(category == "initial_plan", first(rule("target_names", node.has(("initial_plan",))), plan(node.at("initial_plan"), joint, "initial_plan"))),
        when(alone, first(rule("target_names", node.has(("execution_decision", "decision_detail"))), rule("decision_of_category", allowed), detail(node.at("decision_detail"), decision, joint))),
        when(
            category.isin("ongoing", "end"),
            first(
                rule("target_names", node.has(("task_progress_percent", "predictions", "execution_decision", "decision_detail"))),
                rule("decision", decision.isin("Continue", "Replan", "Takeover", "End")),
                rule("decision_of_category", allowed),
                _progress(node.at("task_progress_percent"), "task_progress"),
                predictions(node.at("predictions"), asked),
                detail(node.at("decision_detail"), decision, joint),
            ),
        ),
    )


@once
def long_memory(node: Node) -> Column:
    """At most eight numbered pairs of action and segment, none twice."""

    def item(one: Node, k: Column) -> Column:
        own = F.slice(one.names(), F.lit(2), F.greatest(F.size(one.names()) - 1, F.lit(0)))
        return first(
            rule("memory_item", one.is_object() & (F.element_at(one.names(), 1) == "index")),
            rule("memory_units", (F.size(own) > 0) & (own == F.filter(F.array(*map(F.lit, UNITS)), lambda u: F.array_contains(own, u)))),
            rule("memory_index", one.at("index").whole() == k),
            *(when(F.array_contains(own, u), visible_text(one.at(u))) for u in UNITS),
        )

    pairs = F.transform(node.items(), lambda x: F.struct(*(folded(F.coalesce(F.trim(F.try_variant_get(x["value"], f"$.{u}", "string")), F.lit(""))).alias(u) for u in UNITS)))
    return first(rule("long_memory_no_list", node.is_list()), rule("long_memory_size", F.size(node.items()) <= MEMORY), each(node, item), rule("long_memory_repeated", F.size(F.array_distinct(pairs)) == F.size(pairs)))


@once
def short_memory(node: Node) -> Column:
    """Nothing, or progress and the units of the last prediction."""
    last = node.at("prediction1")
    own = last.names()
    there = ~F.coalesce(F.is_variant_null(node.value), F.lit(True))
    return when(
        there,
        first(
            rule("short_memory_names", node.has(("task_progress_percent", "prediction1"))),
            rule("short_memory_units", last.is_object() & (F.size(own) > 0) & (own == F.filter(F.array(*map(F.lit, UNITS)), lambda u: F.array_contains(own, u)))),
            _progress(node.at("task_progress_percent"), "task_progress"),
            *(when(F.array_contains(own, u), _unit(last.at(u))) for u in UNITS),
        ),
    )


@parsed
def prompt_context(node: Node, context: Column, category: Column, spec: Column) -> Column:
    """What a prompt may hold by the name of its context: nothing, memories, or memories and the initial plan."""
    joint = F.array_contains(F.from_json(document(spec).at("plan_units").text, "array<string>"), "segment")
    wanted = F.lit(False)
    for name, names in CONTEXTS.items():
        wanted = F.when(context == name, node.has(names)).otherwise(wanted)
    some = context != "no_memory_no_initial"
    initial = node.at("initial_plan_memory")
    return first(
        rule("context_no_object", node.is_object()),
        rule("context_unknown", context.isin(*CONTEXTS)),
        when(some & (category == "initial_plan"), rule("context_of_plan", F.lit(False))),
        rule("context_names", wanted),
        when(context.isin(*(n for n, names in CONTEXTS.items() if len(names) == 3)), first(rule("initial_plan_memory_empty", initial.is_list() & (F.size(initial.items()) > 0)), output_spec(spec, category), plan(initial, joint, "initial_plan_memory"))),
        when(some, first(long_memory(node.at("long_memory")), short_memory(node.at("short_memory")))),
    )


@once
def _level(node: Node, field: str, next_one: Column | None = None, more: Sequence[str] = ()) -> Column:
    """A unit of a level: level, source (of the lowest), caption and what else it has."""
    names = ("level", *(("source",) if field == "l0" else ()), "caption", *more)
    return first(
        rule("level_names", node.has(names)),
        rule("level", node.at("level").string() == LEVELS[field]),
        *([rule("source", node.at("source").string().isin("human_segment", "segment"))] if field == "l0" else []),
        _caption(node.at("caption")),
        *([_progress(node.at("progress_percent"))] if "progress_percent" in more else []),
        *([when(next_one, rule("next_progress", node.at("progress_percent").whole() == 0))] if next_one is not None else []),
    )


@once
def _task(node: Node, more: Sequence[str] = ()) -> Column:
    return first(rule("task_names", node.has(("level", "caption", *more))), rule("task_level", node.at("level").string() == "L3"), _caption(node.at("caption")), *([_progress(node.at("progress_percent"), "task_progress")] if more else []))


def _by_profile(profile: Column, rules: Callable[[tuple[str, ...]], Column]) -> Column:
    return first(rule("profile", profile.isin(*PROFILES)), *(when(profile == name, rules(fields)) for name, fields in PROFILES.items()))


@parsed
def level_target(node: Node, profile: Column, count: Column | None = None) -> Column:
    """A task and one or two predictions with a unit for each of the profile's fields."""

    def one(fields: tuple[str, ...]) -> Callable[[Node, Column], Column]:
        return lambda item, k: first(
            rule("prediction_names", item.has(("index", *fields))), rule("prediction_index", item.at("index").whole() == k), *(_level(item.at(f), f, k == 2, ("progress_percent",)) for f in fields)
        )

    @once
    def inner(said: Node) -> Column:
        n = F.size(said.items())
        return first(
            rule("predictions_count", said.is_list() & n.isin(1, 2)),
            *([rule("predictions_expected", F.coalesce(n == count, count.isNull()))] if count is not None else []),
            _by_profile(profile, lambda fields: each(said, one(fields))),
        )

    return first(
        rule("profile", profile.isin(*PROFILES)),
        rule("target_names", node.has(("task", "predictions"))),
        _task(node.at("task"), ("progress_percent",)),
        inner(node.at("predictions")),
    )


@parsed
def window_target(node: Node, profile: Column, ends: Column) -> Column:
    """A target of two predictions whose next units say that the task is complete exactly where the window ends it."""
    return first(level_target(node.text, profile, F.lit(2)), bound(node.at("predictions").items(), lambda items: _window_rules(items, profile, ends)))


def _window_rules(items: Column, profile: Column, ends: Column) -> Column:
    now, then = (Node(F.get(items, F.lit(k))["text"], F.get(items, F.lit(k))["value"]) for k in (0, 1))
    is_end = lambda item, f: F.coalesce(item.at(f).at("caption").string() == TERMINAL, F.lit(False))

    def rules(fields: tuple[str, ...]) -> Column:
        none = F.lit(True)
        for f in fields:
            none = none & ~is_end(now, f) & ~is_end(then, f)
        return first(
            rule("window_end", is_end(then, fields[0]) == ends),
            when(ends, first(*(rule("terminal_caption", is_end(then, f)) for f in fields))),
            when(~ends, rule("terminal_inside", none)),
        )

    return _by_profile(profile, rules)


@parsed
def level_plan(node: Node, profile: Column, count: Column | None = None) -> Column:
    """A task and its plan: numbered units of the profile's first level, each with those of the next one in it."""

    def unit(fields: tuple[str, ...]) -> Callable[[Node, Column], Column]:
        field, below = fields[0], fields[1:]
        more = (CHILDREN[below[0]],) if below else ()

        children = once(lambda held: first(rule("children", held.is_list() & (F.size(held.items()) > 0)), each(held, unit(below))))
        inner = once(lambda own: first(_level(own, field, None, more), *([children(own.at(more[0]))] if below else [])))

        def rules(item: Node, k: Column) -> Column:
            return first(rule("plan_names", item.has(("index", field))), rule("plan_index", item.at("index").whole() == k), inner(item.at(field)))

        return rules

    @once
    def units_of(said: Node) -> Column:
        return first(
            rule("plan_empty", said.is_list() & (F.size(said.items()) > 0)),
            *([rule("plan_expected", F.coalesce(F.size(said.items()) == count, count.isNull()))] if count is not None else []),
            _by_profile(profile, lambda fields: each(said, unit(fields))),
        )

    return first(
        rule("profile", profile.isin(*PROFILES)),
        rule("target_names", node.has(("task", "initial_plan"))),
        _task(node.at("task")),
        units_of(node.at("initial_plan")),
    )


@parsed
def instructed_target(node: Node, profile: Column, kind: Column, instruction: Column, ends: Column) -> Column:
    """A window's target or an initial plan without its task, which the prompt's instruction stands for."""
    whole = node.at("task_progress_percent").text
    said = F.to_json(F.struct(F.lit("L3").alias("level"), instruction.alias("caption")))
    window = F.concat(F.lit('{"task":'), said.substr(F.lit(1), F.length(said) - 1), F.lit(',"progress_percent":'), whole, F.lit('},"predictions":'), node.at("predictions").text, F.lit("}"))
    planned = F.concat(F.lit('{"task":'), said, F.lit(',"initial_plan":'), node.at("initial_plan").text, F.lit("}"))
    return first(
        rule("kind", kind.isin("initial_plan", "continuous", "terminal")),
        rule("instruction", is_latin_caption(instruction) & instruction.isNotNull()),
        when(kind == "initial_plan", first(rule("plan_of_end", ~ends), rule("target_names", node.has(("initial_plan",))), level_plan(planned, profile))),
        when(kind != "initial_plan", first(rule("target_names", node.has(("task_progress_percent", "predictions"))), _progress(node.at("task_progress_percent"), "task_progress"), window_target(window, profile, ends))),
    )
