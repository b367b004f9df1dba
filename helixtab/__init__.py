"""helixtab: tables of sequence pairs, anchors, chains and template switches on Spark."""
