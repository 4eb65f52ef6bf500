from . import arrays, dates, hashing, jsons, maths, text, versions  # noqa: F401
