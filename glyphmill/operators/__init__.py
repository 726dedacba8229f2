"""DataFrame operators: conversion, statistics, dictionaries, words, markup tokens and books."""
