"""Table operators: timetable, zones, travel time, accessibility, equity, plans."""
