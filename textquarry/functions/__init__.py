"""Part of textquarry: functions."""
