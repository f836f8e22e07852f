"""Named queries over the data folder, with SQL to hold them against."""

from polyquill.plans import evaluation, general

CATALOGS = [evaluation, general]
