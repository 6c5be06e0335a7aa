from importlib import import_module

MODULES = ("q_trees", "q_features", "q_assembly", "q_evaluation", "q_learning", "q_design")


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
