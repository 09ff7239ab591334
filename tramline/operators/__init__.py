"""Relational operators over the four timetable tables."""
