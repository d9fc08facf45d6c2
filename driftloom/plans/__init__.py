"""Public flows, each a composition of operators over tables."""
