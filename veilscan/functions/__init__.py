"""Row-level building blocks: functions from Column to Column."""
