from wardtable.functions.expressions import *  # noqa: F401,F403
