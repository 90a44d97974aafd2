from chronotext.functions import rules, text  # noqa: F401
