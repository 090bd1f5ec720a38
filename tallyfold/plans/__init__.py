"""The playing-time forecast, composed from the operators."""
