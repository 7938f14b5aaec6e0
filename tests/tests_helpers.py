from test_checks import D, con, inv, led  # noqa: F401  shared row builders
