"""Steps of panel preparation: functions from DataFrames to DataFrames that keep all other columns."""
