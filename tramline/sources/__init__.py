"""Readers and writers of timetables."""
