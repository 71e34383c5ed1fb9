from ordertide.functions import dates, fmt, normal, numeric  # noqa: F401
