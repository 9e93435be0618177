from ohmwatch.functions import axis, diagnostics, guards  # noqa: F401
