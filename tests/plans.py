"""What the nodes of an executed plan made."""


def most_rows(df) -> int:
    """Runs ``df``: the most rows that any node of its plan made."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    todo, most = [execution.executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            made = node.metrics().get("numOutputRows")
            most = max(most, made.get().value() if made.isDefined() else 0)
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return most
