"""Values that several test modules share."""

import datetime as dt

NOW = dt.datetime(2024, 2, 1)
